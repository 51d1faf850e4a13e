"""Shared spans against brute force: edges of spans near the threshold, periodic bytes, hot headers, blocks and copies."""

import random
import time

import pytest

from factloom.llm import shared_spans


def _covered(a: bytes, others: list[bytes], size: int) -> int:
    grams = {b[k : k + size] for b in others for k in range(len(b) - size + 1)}
    inside = bytearray(len(a))
    for k in range(len(a) - size + 1):
        if a[k : k + size] in grams:
            inside[k : k + size] = b"\1" * size
    return sum(inside)


def _brute(contents: dict[int, bytes], size: int = 400):
    grams = {i: {c[k : k + size] for k in range(len(c) - size + 1)} for i, c in contents.items()}
    return {(i, j) for i in contents for j in contents if i < j and grams[i] & grams[j]}


def _files(rng: random.Random) -> list[bytes]:
    noise = lambda n: bytes(rng.randrange(256) for _ in range(n))
    header = noise(390)
    pool = [noise(n) for n in (398, 399, 400, 401, 420, 470, 545, 900, 1500)] + [b"\0" * 800, b"ab" * 300, b"abc" * 200]
    out = []
    for k in range(60):
        body = b"".join(rng.choice((noise(rng.randrange(0, 60)), rng.choice(pool), noise(rng.randrange(0, 500)))) for _ in range(rng.randrange(1, 5)))
        out.append((header if k % 3 == 0 else b"") + body)
    edited = bytearray(pool[8])
    edited[700] ^= 1
    return out + [bytes(edited), pool[8], pool[2], pool[2] + b"x", b"x" + pool[2], pool[0], out[0], out[0], b"\0" * 400, b"\0" * 399, b"\0" * 5000]


@pytest.mark.parametrize("block", (2000, 2))
def test_against_brute_force(spark, tables, source_rows, monkeypatch, block):
    monkeypatch.setattr(shared_spans, "BLOCK", block)
    contents = dict(enumerate(_files(random.Random(block)), 1))
    directory = tables(source_documents=source_rows({f"a/{k}": c for k, c in contents.items()}))
    expected = _brute(contents)
    rows = [tuple(r) for r in shared_spans.found(spark, directory).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected
    shares = {r.file_id: r.shared_bytes for r in shared_spans.shares(spark, directory).collect()}
    assert shares == {i: _covered(c, [x for j, x in contents.items() if j != i], 400) for i, c in contents.items()}
    links = {r.file_id: (r.copies, r.links) for r in shared_spans.links(spark, directory).collect()}
    for i, c in contents.items():
        if len(c) >= 400:
            partners = [contents[b if a == i else a] for a, b in expected if i in (a, b)]
            assert links[i] == (1 + partners.count(c), len(partners) - partners.count(c))
        else:
            assert i not in links


def test_periodic_bytes_take_linear_time():
    for data in (b"a" * 4000, b"ab" * 2000, bytes(100_000)):
        hashes, positions = shared_spans.placed_anchors(data)
        began = time.perf_counter()
        key, _, first, last = shared_spans.windows(data, {int(h): True for h in set(hashes.view("int64").tolist())})
        assert time.perf_counter() - began < 0.05 * max(1, len(data) / 4000)
        assert len(key) <= 2 and first.min() == 0 and last.max() + 400 == len(data) and len(positions) == len(hashes)


def test_one_header_in_many_files(spark, tables, source_rows):
    """A header below the threshold links nothing although every file has its anchors; one above it links all."""
    rng = random.Random(1)
    noise = lambda n: rng.randbytes(n)
    short, long = noise(395), noise(420)
    files = {f"a/{k}": short + noise(300) for k in range(300)} | {f"b/{k}": long + noise(300) for k in range(100)}
    directory = tables(source_documents=source_rows(files))
    assert shared_spans.found(spark, directory).count() == 100 * 99 // 2
    assert {r.links for r in shared_spans.links(spark, directory).collect()} == {0, 99}
