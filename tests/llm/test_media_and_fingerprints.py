import gzip
import hashlib
import math
import struct
import time
import zlib
from collections import Counter

import numpy as np

from spindrift.llm import fingerprints, media


def png():
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def test_sniffing():
    sound = media.wav(b"abc" * 50)
    assert media.sniff(sound) == ("audio/wav", [])
    assert media.sniff(png(), "image/jpeg")[0] == "image/png"
    assert media.sniff(b"text GIF89a and BM and RIFF in words", "text/plain") == ("text/plain", [])
    kind, carved = media.sniff(b"lead " + png() + b" tail " + gzip.compress(b"x" * 99) + b" end")
    assert kind == media.UNKNOWN and [(a, k) for a, _, k in carved] == [(5, "image/png"), (5 + len(png()) + 6, "application/gzip")]
    broken = png()[:-5]
    assert media.sniff(broken, "image/png") == ("image/png", []) and media.sniff(broken)[0] == media.UNKNOWN
    assert media.sniff(b"") == (media.UNKNOWN, [])
    assert media.sniff(media.wav(b"xx" + png()))[1] == [(46, len(png()), "image/png")]


def test_round_trip(docs):
    rows = [(1, "Hellö"), (2, None), (3, ""), (4, "x" * 64), (None, "Hellö"), (5, "ä" * 100_000), (6, "RIFF BM " + "a" * 9)]
    got = media.inspect_media(media.store_texts(docs(rows))).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        payload = media.padded(texts[r.doc_id])
        assert len(payload) % 64 == 0 and len(payload) >= 64
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len((texts[r.doc_id] or "").encode()), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.media_type == "audio/wav"
        assert r.media_sha256 == hashlib.sha256(media.wav(payload)).hexdigest()
    assert len({r.feature for r in got if texts[r.doc_id] == "Hellö"}) == 1


def test_end_marks_are_looked_for_once():
    """Repeated magic bytes, with and without an end mark far behind them: time follows the length."""

    def seconds(value):
        began = time.process_time()
        media.sniff(value)
        return time.process_time() - began

    for unit, tail in ((b"%PDF-1", b""), (b"PK\3\4", b""), (b"%PDF-1", b"%%EOF"), (b"PK\3\4", b"PK\5\6" + b"\1" * 18), (b"\xff\xd8\xff\xda\0\2", b""), (b"GIF89a", b""), (b"RIFF", b"")):
        small, large = seconds(unit * 20_000 + tail), seconds(unit * 200_000 + tail)
        assert large < 40 * max(small, 0.02), unit


def test_ends_of_found_media():
    pdf = b"%PDF-1.4 text startxref 9 %%EOF"
    assert media.sniff(pdf) == ("application/pdf", []) and media.sniff(b"%PDF-1.4 %%EOF startxref")[0] == media.UNKNOWN
    assert media.sniff(b"ab" + pdf + b"cd" + pdf)[1] == [(2, len(pdf), "application/pdf"), (4 + len(pdf), len(pdf), "application/pdf")]
    empty_zip = b"PK\3\4" + b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, 0, 0, 0, 4, 0)
    assert media.sniff(empty_zip)[0] == "application/zip"
    big = gzip.compress(bytes(300_000)) + b"behind"
    assert media.sniff(b"x" + big)[1] == [(1, len(big) - 6, "application/gzip")]


def test_feature_by_hand(docs):
    rows = [(1, "Hellö and some words"), (2, ""), (3, "a" * 64), (4, "zebra " * 500)]
    got = {r.doc_id: r.feature for r in media.inspect_media(media.store_texts(docs(rows))).collect()}
    for i, text in rows:
        x = list(media.padded(text))
        mean = sum(x) / len(x)
        dev = math.sqrt(sum((v - mean) ** 2 for v in x) / len(x))
        cross = sum((a > mean) != (b > mean) for a, b in zip(x, x[1:], strict=False))
        bits = -sum(n / len(x) * math.log2(n / len(x)) for n in Counter(x).values())
        have = dict(f.split("=") for f in got[i].split(";")[1:])
        assert (int(have["peak"]), int(have["cross"]), have["carved"]) == (max(x), cross, "")
        assert all(abs(float(have[k]) - v) < 1e-3 for k, v in (("mean", mean), ("dev", dev), ("bits", bits)))


def test_no_media(docs):
    none = docs([(1, "a")]).where("doc_id > 1")
    assert media.inspect_media(media.store_texts(none)).collect() == []


def brute(table):
    """Rows in the order of ids, equal ids in that of a hash of their texts."""
    rows = table.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) tie").collect()
    rows = [(r.doc_id, r.text) for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.tie, r.text or ""))]
    out = []
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(t) // 4
        out.append((i, len(t), hashlib.sha256((t[: len(t) - n] + after[:n]).encode()).hexdigest()))
    return sorted(out, key=str)


def test_edit_probe(docs, monkeypatch):
    monkeypatch.setattr(fingerprints, "PLACE_CHARS", 300)
    rows = [(3 * k, " ".join(f"w{(k * 7 + j) % 90}" for j in range(k % 30))) for k in range(60)] + [(None, "null id"), (None, None), (9, "same id"), (500, "é" * 999), (-4, "")]
    table = docs(rows)
    got = fingerprints.edit_probe(table, fingerprints.lexicon(table)).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == brute(table)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_ranges_of_uneven_ids(docs, monkeypatch):
    """One far id, the ends of the type, and many rows of one id or none still fall into ranges of like size."""
    monkeypatch.setattr(fingerprints, "PLACE_CHARS", 1500)
    text = lambda k: " ".join(f"w{(k * 7 + j) % 90}" for j in range(20))
    rows = [(k, text(k)) for k in range(300)] + [(1 << 60, "far"), (-(1 << 63), "least"), ((1 << 63) - 1, "most")] + [(None, f"{text(k)} {k}") for k in range(150)] + [(7, f"{text(k)} {k}") for k in range(150)]
    table = docs(rows)
    sizes = [r["count"] for r in fingerprints._placed(table).groupBy("place").count().collect()]
    assert len(sizes) > 20 and max(sizes) < len(rows) / 8
    got = fingerprints.edit_probe(table, fingerprints.lexicon(table)).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == brute(table)


def test_fingerprint_by_hand(docs, monkeypatch):
    """Two texts agree in a part if, and only if, they have the same terms of it."""
    import re

    rows = [(k, " ".join(f"w{(k * 5 + j * j) % 60}" for j in range(40))) for k in range(40)]
    table = docs(rows)
    lex = fingerprints.lexicon(table, 0.05, 0.9)
    df = {}
    for _, t in rows:
        for x in set(t.split()):
            df[x] = df.get(x, 0) + 1
    middling = {x for x, n in df.items() if 0.05 * len(rows) <= n <= 0.9 * len(rows)}
    assert len(lex) == len(middling) > 0
    prints = {r.doc_id: re.findall("....", r.fingerprint) for r in fingerprints.fingerprint(table, lex).collect()}
    terms = {i: frozenset(t.split()) & middling for i, t in rows}
    one = {r.text: re.findall("....", r.fingerprint) for r in fingerprints.fingerprint(docs([(k, x) for k, x in enumerate(sorted(middling))]), lex).withColumnRenamed("doc_id", "k").collect() for r in [type("R", (), {"text": sorted(middling)[r.k], "fingerprint": r.fingerprint})]}
    for i, have in terms.items():
        for j, other in terms.items():
            for place in range(fingerprints.PARTS * fingerprints.LEVELS):
                own = lambda s: {x for x in s if one[x][place] != "0000"}  # noqa: B023, E731
                assert (prints[i][place] == prints[j][place]) == (own(have) == own(other))


def test_single_and_empty(docs):
    one = docs([(1, "just one document here")])
    lex = fingerprints.lexicon(one)
    r = fingerprints.edit_probe(one, lex).collect()
    assert len(r) == 1 and r[0].near_next == 1.0
    assert fingerprints.edit_probe(one.where("doc_id > 1"), lex).collect() == []


def test_equal_texts_and_edits(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lex = fingerprints.lexicon(table)
    rows = fingerprints.edit_probe(table, lex).collect()
    assert np.mean([r.near_edited for r in rows]) > 0.3 > 0.05 > np.mean([r.near_next for r in rows])
    texts = {r.doc_id: r.text for r in table.collect()}
    by_text = {}
    for r in fingerprints.fingerprint(table, lex).collect():
        assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
