"""Cutting long texts at sentence ends."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_text(text: str, limit: int) -> Column:
    """Pieces of the column's text of at most `limit` characters: sentences are packed greedily with single spaces, one that
    is too long is cut hard. JVM only: sentences are cut first, then folded.

    A cut piece that was followed by more of its sentence stands by itself and closes what was being packed.
    """
    sentences = f"split({text}, '(?<=[.!?。！？])(?U:\\\\s+)')"
    units = f"""flatten(transform({sentences}, s -> if(length(s) <= {limit}, array(named_struct('t', s, 'cut', false)),
        transform(sequence(0, cast((length(s) - 1) div {limit} as int)), k -> named_struct('t', substring(s, k * {limit} + 1, {limit}), 'cut', k < (length(s) - 1) div {limit})))))"""
    fold = f"""aggregate({units}, named_struct('p', cast(array() as array<string>), 'c', ''), (s, u) -> case
        when u.cut then named_struct('p', s.p || if(s.c = '', cast(array() as array<string>), array(s.c)) || array(u.t), 'c', '')
        when s.c = '' then named_struct('p', s.p, 'c', u.t)
        when length(s.c) + 1 + length(u.t) > {limit} then named_struct('p', s.p || array(s.c), 'c', u.t)
        else named_struct('p', s.p, 'c', s.c || ' ' || u.t) end, s -> s.p || if(s.c = '', cast(array() as array<string>), array(s.c)))"""
    return F.expr(f"if(length({text}) <= {limit}, array({text}), {fold})")


def join_pieces(pieces: Column, spaced: bool = False) -> Column:
    return F.array_join(pieces, " " if spaced else "")
