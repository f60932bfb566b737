"""Encoding, packing and media: equal to the tokenizer library, exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from edge_rows import no_docs, odd_docs, odd_texts  # noqa: F401
from tokenizers import Tokenizer

from tidepanel.llm import bpe, flac, packing
from tidepanel.llm.common import tokenizer_path


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def ids_of(data):
    return np.frombuffer(data, "<u4").tolist()


def random_texts(n, seed=1):
    rnd = random.Random(seed)
    letters = " \n\t\r'aesttvlrmd12!?.é漢  字😀\x00\x1c\x85ß"
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def test_encoders_equal_the_library(library):
    texts = random_texts(3000) + [t or "" for t in odd_texts()]
    for own in (bpe.Encoder(tokenizer_path(), cache_words=500), bpe.LibraryEncoder(tokenizer_path())):
        for run in bpe.in_chunks(texts, 5000):
            for text, got in zip(run, own.encode(run)):
                want = library.encode(text, add_special_tokens=False).ids
                assert ids_of(got) == want, repr(text[:60])
                assert own.decode(got).decode() == library.decode(want, skip_special_tokens=False)


def test_round_trip_digests(spark, odd_docs, no_docs, library):
    rows = bpe.round_trip(odd_docs).collect()
    texts = {i: t or "" for i, t in enumerate(odd_texts())} | {None: "a row without an id"}
    assert len(rows) == len(texts) + 1
    for r in rows:
        want = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert bpe.round_trip(no_docs).count() == 0
    ids = bpe.encode_column(odd_docs.where("doc_id = 6")).first().ids
    assert ids == library.encode("one two", add_special_tokens=False).ids


def check_packing(pieces, texts, library):
    """``texts``: (id, text) of each row; ids may repeat."""
    want = {}
    for key, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        want.setdefault(key, []).append(np.array(ids, "<u4").tobytes())
    sequences, covered = {}, {}
    for p in pieces:
        data = [d for d in want[p.doc_id] if len(d) == 4 * p.doc_tokens]
        assert any(zlib.crc32(d[4 * p.start : 4 * (p.start + p.length)]) == p.ids_crc32 for d in data)
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length, p.context))
        covered.setdefault(p.doc_id, []).append((p.start, p.length))
    for parts in sequences.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 1024 and {c for *_, c in parts} == {at}
        assert at == 1024 or at & (at - 1) == 0  # a power of two, so nothing is padded
    for key, data in want.items():
        assert sum(n for _, n in covered[key]) == sum(len(d) // 4 for d in data)
        if len(data) == 1:
            at = 0
            for start, length in sorted(covered[key]):
                assert start == at
                at += length


def test_packing(spark, odd_docs, no_docs, library):
    pieces = packing.pack(odd_docs).collect()
    check_packing(pieces, [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()], library)
    assert packing.pack(no_docs).count() == 0


def test_packing_prefers_whole_short_documents():
    packer = packing.Packer()
    lengths = [700, 300, 24, 1500, 548, 60, 40, 9]
    for k, n in enumerate(lengths):
        packer.add(k, bytes(4 * n))
    packer.drain()
    packer.finish()
    rows = packer.rows()
    whole = [r for r in rows if r[0] == 0]
    assert len(whole) == 1 and whole[0][7] == 1024  # the largest document opens a window uncut
    assert sum(r[2] for r in rows) == sum(lengths)
    assert all(r[7] & (r[7] - 1) == 0 for r in rows)


def test_step_groups_hold_equal_tokens():
    packer = packing.Packer(step_tokens=4096)
    for k in range(400):
        packer.add(k, bytes(4 * (37 * k % 900 + 1)))
        if k % 50 == 0:
            packer.drain()
    packer.drain()
    tokens = {}
    for r in packer.rows():
        tokens.setdefault((r[7], r[8]), 0)
        tokens[r[7], r[8]] += r[2]
    by_size = {}
    for (size, group), n in tokens.items():
        by_size.setdefault(size, {})[group] = n
    for groups in by_size.values():
        assert all(n == 4096 for g, n in groups.items() if g != max(groups))


def payloads():
    rnd = random.Random(2)
    made = [flac.payload_of(t)[1] for t in odd_texts()]
    made += [rnd.randbytes(64 * k) for k in (1, 3, 17, 40)]
    made += [bytes(range(256)) * 9, b"\0" * 1024 + b"\xff" * 64, bytes([0] * 60 + [255] * 4) * 3, bytes([128]) * 2048]
    return made


def test_flac_round_trip_and_seek():
    data = payloads()
    streams = flac.encode(data)
    assert flac.decode(streams) == data
    kinds = set()
    for stream, payload in zip(streams, data):
        total, points, begin, _ = flac.seek_points(stream)
        assert total == len(payload) and [p[0] for p in points] == list(range(0, total, flac.BLOCK))
        for _, offset, _ in points:
            head = flac.parse_header(stream[begin + offset :][: flac._head_bytes(np.frombuffer(stream, np.uint8), begin + offset)])
            kinds.add(stream[begin + offset + head[2]] >> 1)
        assert flac.read_samples(stream, total - 64, 64) == payload[-64:]
        assert flac.read_samples(stream, 10, 30) == payload[10:40]
    assert {flac.CONSTANT, flac.VERBATIM, flac.FIXED} <= kinds and any(k >= flac.LINEAR for k in kinds)


def test_flac_damage_is_found():
    stream = flac.encode([flac.payload_of("some words " * 300)[1]])[0]
    begin = flac.seek_points(stream)[2]
    for at in (begin + 2, begin + 40, len(stream) - 1, 30):
        bad = bytearray(stream)
        bad[at] ^= 4
        with pytest.raises((ValueError, StopIteration)):
            flac.decode([bytes(bad)])


def test_media_columns(spark, odd_docs, no_docs):
    texts = {i: t or "" for i, t in enumerate(odd_texts())} | {None: "a row without an id"}
    rows = flac.media_digests(odd_docs).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        n, payload = flac.payload_of(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes) == (n, len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
    by_text = {}
    for r in rows:
        by_text.setdefault(texts[r.doc_id], set()).add((r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in by_text.values())
    assert flac.media_digests(no_docs).count() == 0
    blocks = flac.pcm_blocks(flac.media_column(odd_docs.where("doc_id = 12"))).orderBy("first_sample").collect()
    assert b"".join(b.pcm for b in blocks) == flac.payload_of("x" * 30000)[1]
