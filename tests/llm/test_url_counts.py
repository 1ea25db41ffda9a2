"""Scores of the URL models against counts without hashing."""

import random
import zlib
from collections import Counter
from math import log

import pytest

from millrace.llm import urlfilter


def exact(train, urls):
    full, head = Counter(), Counter()
    for url, side in train:
        for i in range(len(url)):
            for k in range(urlfilter.ORDER + 1):
                c = url[max(0, i - k) : i].rjust(k, "\0")
                full[side, k, c, url[i]] += 1
                head[side, k, c] += 1
    out = []
    for url in urls:
        total = 0.0
        for i in range(len(url)):
            for side in (0, 1):
                p = 1 / 256
                for k in range(urlfilter.ORDER + 1):
                    c = url[max(0, i - k) : i].rjust(k, "\0")
                    p = (full[side, k, c, url[i]] + urlfilter.WEIGHT * p) / (head[side, k, c] + urlfilter.WEIGHT)
                total += log(p) if side else -log(p)
        out.append(total / len(url))
    return out


@pytest.mark.parametrize("bound", [500_000, 100])
def test_scores_equal_exact_counts(spark, monkeypatch, bound):
    monkeypatch.setattr(urlfilter, "BROADCAST_ROWS", bound, raising=False)
    rng = random.Random(3)
    draw = lambda letters: "http://" + "".join(rng.choice(letters) for _ in range(40))
    rows = [(i, draw("abcdefghijklmnopqrst" if i % 2 else "hijklmnopqrstuvwxyz/"), i % 2) for i in range(4000)]
    labelled = spark.createDataFrame(rows, "id long, url string, side int")
    pages = [(i, u) for i, u, _ in rows[:60]] + [(9001, draw("abcxyz"))]
    got = {r.id: (r.score, r.verdict) for r in urlfilter.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), rules=[], labelled=labelled).collect()}
    want = exact([(u, s) for i, u, s in rows if zlib.crc32(str(i).encode()) % 5], [u for _, u in pages])
    assert max(abs(got[i][0] - w) for (i, _), w in zip(pages, want)) < 1e-8
    assert all((got[i][1] == "allow") == bool(i % 2) for i, _ in pages[:60])
