"""Secrets that cross blanks, line breaks and bad bytes of an encoded passage."""

import base64
import bz2
import gzip
import lzma
import random
import zlib

import pytest
import zstandard

from paraqa.llm import secrets

VALUE = "Abcd1234Efgh5678"
ACCESS = "AKIA" + "ABCDEFGH12345678"


def found(text):
    """(kind, what the span covers) of the spans that the base rules miss."""
    base, spans, *_ = secrets.scan(text)
    return {(secrets.KINDS[k], text[a:z]) for a, k, z in spans if (a, k, z) not in base}


QUOTE, EQUALS = (chr(92) + "u00" + x for x in ("22", "3d"))


@pytest.mark.parametrize("text", ["{" + QUOTE + "api_key" + QUOTE + ": " + QUOTE + VALUE + QUOTE + "}", f"password%3A {VALUE}", f"password{EQUALS} {VALUE}", f"a%20b token = %41{VALUE[1:]}"])
def test_escapes_are_decoded_over_blanks(text):
    (kind, span), = found(text)
    assert kind == "assign" and span.endswith(VALUE[1:])


@pytest.mark.parametrize("pack", [lambda x: x, gzip.compress, zlib.compress])
@pytest.mark.parametrize("lead", ["", "word\n", "data: ", "ab\ncdefg\n"])
@pytest.mark.parametrize("line", ["\n", "\r\n  "])
def test_wrapped_base64(pack, lead, line):
    rng = random.Random(1)
    noise = " ".join(str(rng.random()) for _ in range(30))
    for fill in range(12):  # so that the key falls on a line break at times
        coded = base64.b64encode(pack(f"{'x' * fill}{noise[: 40 + fill]} {ACCESS} {noise}".encode())).decode()
        text = lead + line.join(coded[k : k + 76] for k in range(0, len(coded), 76)) + "\nend of it"
        assert any(k == "access" for k, _ in found(text)), (fill, text)


def test_spans_of_wrapped_base64():
    coded = base64.b64encode(f"{'x' * 50} {ACCESS} end".encode()).decode()
    (kind, span), = found(coded[:76] + "\n" + coded[76:])
    a = 4 * (51 // 3)
    assert kind == "access" and coded[a:].startswith(span.split("\n")[0]) and "\n" in span


def test_bad_bytes_hide_no_secret():
    key = f" {ACCESS} "
    for text in (f"https://h/?city=M%FCnchen&password%3D{VALUE}", f"?x=%00&secret%3D{VALUE}", f"%E4%b8%ff%41{ACCESS[1:]}"):
        (_, span), = found(text)
        assert span.endswith(VALUE) or span.endswith(ACCESS[1:]), text
    for data in (b"\0" + key.encode(), b"\xff\xfeabc" + key.encode() + b"\xe4", key.encode("utf-16"), key.encode("utf-16-be"), bytes(range(256)) + key.encode()):
        for packed in (data, gzip.compress(data)):
            coded = base64.b64encode(packed).decode()
            assert any(k == "access" for k, _ in found(f"see {coded} ok")), data
    # the span is still that of the key
    coded = base64.b64encode(b"\xff\xe4\xb8\x00\xfc\xe9" + "é".encode() + ACCESS.encode()).decode()
    (_, span), = found(coded)
    assert span == coded[8 * 8 // 6 :].rstrip("=")


def test_binary_without_a_long_stretch_is_no_layer():
    rng = random.Random(2)
    for _ in range(50):
        assert secrets.scan("x " + base64.b64encode(rng.randbytes(90)).decode())[2] == 1


def raw(data):
    one = zlib.compressobj(9, zlib.DEFLATED, -15)
    return one.compress(data) + one.flush()


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress, raw, bz2.compress, lzma.compress, lambda x: lzma.compress(x, lzma.FORMAT_ALONE), zstandard.compress, lambda x: gzip.compress(x[:9]) + gzip.compress(x[9:])])
def test_all_formats_are_inflated_whole(pack, monkeypatch):
    noise = random.Random(3).randbytes(400)
    for data in (noise + f" {ACCESS} ".encode() + noise, "é".encode() * 3000 + ACCESS.encode()):
        coded = base64.b64encode(pack(data)).decode()
        assert ("access", coded.rstrip("=")) in found(f"see {coded} ok")
    monkeypatch.setattr(secrets, "WINDOW", 512)
    monkeypatch.setattr(secrets, "OVERLAP", 128)
    monkeypatch.setattr(secrets, "PIECE", 64)
    for at in range(400, 520, 7):  # over a border
        coded = base64.b64encode(pack(b"\0" * at + ACCESS.encode() + b"\0" * 900)).decode()
        assert ("access", coded.rstrip("=")) in found(f"see {coded} ok"), at


def test_secret_beyond_64_megabytes():
    coded = base64.b64encode(gzip.compress(b"\0" * (66 << 20) + ACCESS.encode())).decode()
    assert {k for k, _ in found(f"see {coded} ok")} == {"access"}


PACKS = [gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.ZstdCompressor().compress]


@pytest.mark.parametrize("outer", PACKS)
@pytest.mark.parametrize("inner", PACKS)
def test_compressed_twice(outer, inner):
    coded = base64.b64encode(outer(inner(f"so {ACCESS} it is".encode()))).decode()
    assert ("access", coded.rstrip("=")) in found(f"see {coded}.")  # small zstandard frames may hold it as it is, too


@pytest.mark.parametrize("lead", ["", "w", "wo", "wor", "word", "words"])
@pytest.mark.parametrize("pack", [lambda x: x, gzip.compress])
def test_words_glued_to_base64(lead, pack):
    coded = base64.b64encode(pack(f"the key is {ACCESS} and no other".encode())).decode()
    assert any(k == "access" for k, _ in found(f"see {lead}{coded}"))


def test_long_unicode_escapes():
    text = "".join(f"{chr(92)}U{ord(c):08x}" for c in ACCESS)
    assert found(text) == {("access", text)}


def test_streams_that_end_early_and_levels_that_repeat():
    rng = random.Random(3)
    data = f"{ACCESS} " + " ".join(str(rng.random()) for _ in range(500))
    for pack in (gzip.compress, zlib.compress):
        assert any(k == "access" for k, _ in found(base64.b64encode(pack(data.encode())[:-60]).decode()))
    assert list(secrets._inflated(gzip.compress(b""), True)) == []


def test_bombs_are_inflated_in_little_memory():
    import tracemalloc

    bomb = zlib.compress(gzip.compress(b"\0" * (24 << 20) + f" {ACCESS} ".encode()), 9)
    text = "x " + base64.b64encode(bomb).decode()
    tracemalloc.start()
    assert any(k == "access" for k, _ in found(text))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20


def plain_worklist(text):
    """Texts at the fixpoint, by another way: strings only, no places."""
    import re
    import urllib.parse

    seen, todo = {text}, [text]
    while todo:
        now = todo.pop()
        new = [urllib.parse.unquote(now, errors="replace"), re.sub(r"\\u([0-9a-f]{4})", lambda m: chr(int(m[1], 16)), now)]
        for run in re.findall(r"[A-Za-z0-9+/]{16,}={0,2}", now):
            try:
                data = base64.b64decode(run + "=" * (-len(run) % 4))
            except ValueError:
                continue
            while True:
                new.append(data.decode("utf-8", "replace"))
                for unpack in (gzip.decompress, zlib.decompress, bz2.decompress):
                    try:
                        data = unpack(data)
                        break
                    except (OSError, EOFError, ValueError, zlib.error):
                        continue
                else:
                    break
        todo += [t for t in new if t not in seen]
        seen.update(new)
    return seen


@pytest.mark.parametrize("seed", range(40))
def test_random_nestings_against_a_plain_worklist(seed):
    import urllib.parse

    rng = random.Random(seed)
    b64 = lambda x: base64.b64encode(x).decode()
    steps = [
        lambda t: f"q {urllib.parse.quote(t, safe='').replace('A', '%41')} r",
        lambda t: "".join(f"{chr(92)}u{ord(c):04x}" if rng.random() < 0.5 else c for c in t),
        lambda t: f"k: {b64(t.encode())} .",
        lambda t: f"g {b64(gzip.compress(t.encode()))} h",
        lambda t: f"z {b64(bz2.compress(zlib.compress(t.encode())))}, y",
    ]
    keys = ["AKIA" + "".join(rng.choices("ABCDEFGHJKLMNPQRSTUVWXYZ23456789", k=16)) for _ in range(2)]
    text = f"one {keys[0]} two"
    for _ in range(rng.randint(1, 4)):
        text = rng.choice(steps)(text)
    text = f"start {text} then {keys[1]} end"
    want = {k for k in keys if any(k in t for t in plain_worklist(text))}
    assert want == set(keys)
    base, spans, *_ = secrets.scan(text)
    assert (text.index(keys[1]), 1, text.index(keys[1]) + 20) in base
    got = {layer.text[a:z] for layer, _ in secrets.layers(text) for a, k, z in secrets.base_spans(layer.text) if k == 1}
    assert want <= got and len([s for s in spans if s[1] == 1]) >= 2
    assert all(0 <= a < z <= len(text) for a, _, z in spans)
