"""Runs of words against a brute force over all starts and periods."""

import random

import numpy as np
import pytest

from orrerium.llm import runs
from orrerium.llm.queries import op13_runs


def by_hand(x, least=12):
    out, n = {}, len(x)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if x[i] != x[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                out.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def sequences():
    rnd = random.Random(11)
    for size in list(range(30)) * 12 + [60, 90, 200, 400] * 12:
        letters = rnd.choice([1, 2, 2, 3, 5])
        x = [rnd.randrange(letters) for _ in range(size)]
        if size > 20 and rnd.random() < 0.6:  # copies of parts, periodic tails, squares of squares
            a, b = sorted(rnd.sample(range(size), 2))
            x = x[:a] + x[a:b] * rnd.randrange(1, 4) + x[b:] + x[a:b] * rnd.randrange(3)
        yield x
    a, b = [0], [0, 1]
    for _ in range(10):
        a, b = b, b + a
        yield b  # Fibonacci words have the most runs
    yield [0, 1] * 40 + [2] + [0, 1] * 40
    yield ([0] * 13 + [1]) * 6
    yield list(range(50)) * 3 + list(range(25))


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_are_those_of_brute_force(least):
    for x in sequences():
        assert runs.find_runs(x, least) == by_hand(x, least), x


def test_factors_are_longest_earlier_matches():
    for x in sequences():
        upto = 0
        for start, size, source in runs.Automaton(x).factors(x):
            assert start == upto
            text = lambda a, n: x[a : a + n]
            if source < 0:
                assert size == 1 and x[start] not in x[:start]
            else:
                assert source < start and text(source, size) == text(start, size)
            if start + size < len(x):
                assert not any(text(k, size + 1) == text(start, size + 1) for k in range(start)) or source < 0
            upto += size
        assert upto == len(x)


def collapsed(text, least=12):
    w = [p for p in text.replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if p]
    found, gone = by_hand(w, least), set()
    for s, n, q in found:
        gone |= set(range(s + q, s + n))
    return len(w), found, " ".join(p for k, p in enumerate(w) if k not in gone)


def test_documents_nulls_and_long_texts(spark):
    rnd = random.Random(2)
    words = ["a", "é", "\x1c", "b\xa0c", "x" * 40, "A", "𝄞"]
    texts = [None, "", " \n\t", "one", "a " * 12, "a " * 11, " \r\x0b".join(["no", "more"] * 30)]
    texts += [rnd.choice([" ", "\n", "  "]).join(rnd.choices(words[: rnd.choice([1, 2, 3, 7])], k=rnd.randrange(1, 90))) for _ in range(150)]
    texts += [" ".join(f"w{k}" for k in range(150)) + " " + "tail of a line " * 5, " ".join(f"w{k % 700}" for k in range(2000))]
    rows = [(None if k % 50 == 9 else k // 2, t, "clash") for k, t in enumerate(texts)]
    got = runs.find(spark.createDataFrame(rows, "doc_id long, text string, runs string").coalesce(1)).collect()
    for (i, text, _), r in zip(rows, got, strict=True):
        assert (r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) == (i, *collapsed(text or ""))
    big = runs.find(spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(300_000)) + " end" * 20_000)], "doc_id long, text string")).first()
    assert [tuple(x) for x in big.runs] == [(300_000, 20_000, 1)] and big.collapsed.endswith("w299999 end")
    assert runs.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_equals_brute_force(spark, sf_dir):
    import hashlib
    import zlib

    got = {r.doc_id: r for r in op13_runs(spark, sf_dir).collect()}
    planted = 0
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        w = [p for p in np.array(list(r.text or ""), dtype=object).sum().translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if p] if r.text else []
        h = zlib.crc32(str(r.doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + k % p] for k in range(n - a)]
            planted += 1
        if n > 1500:
            continue
        _, found, text = collapsed(" ".join(w))
        top = max(found, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        mine = got[r.doc_id]
        assert (mine.n_runs, mine.start, mine.length, mine.period) == (len(found), *(top or (None,) * 3))
        assert mine.exponent_milli == (1000 * top[1] // top[2] if top else None)
        assert mine.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        assert mine.collapsed_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert planted > 3
