"""The pipeline's stages, each on its own input, against brute force."""

import math
import re
from collections import Counter

import corpus_pipeline
import sentencepiece
import xxhash

from pixelloom.llm import base
from pixelloom.llm.queries import PIECES

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_copies", "benchmarks", "pieces"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, SF).cache()
        rows, had = {r.doc_id: r for r in after.collect()}, {r.doc_id: r for r in before.collect()}
        assert set(rows) <= set(had) and rows
        if i < 4:
            assert after.columns == columns
        if name == "quality":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            assert sum(labels[d] == 1 for d in rows if d in labels) >= 0.97 * sum(q == 1 for d, q in labels.items() if d in had)
        if name == "lines":
            seen = [x for r in rows.values() for x in r.text.split("\n") if x.strip(" ")]
            assert len(seen) == len(set(seen)) and all(r.n_chars == len(r.text) for r in rows.values())
        if name == "benchmarks":
            windows = {tuple(w[k : k + 8]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for w in [cut(r.text)] for k in range(max(1, len(w) - 7))}
            dirty = {d for d, r in had.items() for w in [cut(r.text)] if any(tuple(w[k : k + n]) in windows for n in {len(x) for x in windows} for k in range(len(w) - n + 1))}
            assert set(rows) == set(had) - dirty
        if name == "pieces":
            sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
            assert all(r.n_tokens == len(sp.encode(had[d].text)) and r.text == sp.decode(sp.encode(had[d].text)) for d, r in rows.items())
        before = after


def classes(items, linked):
    root = list(range(len(items)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(items)):
        for j in range(i + 1, len(items)):
            if linked(items[i], items[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(items))]


def brute_quality(docs, labels):
    """The k documents with the largest weight and noise; k is the labelled share of good ones."""

    def grams(t):
        raw = f" {t} ".encode()
        w = t.split()
        return [(int.from_bytes(raw[k : k + 3], "little") * 0x9E3779B1 & 0xFFFFFFFF) >> 16 for k in range(len(raw) - 2)] + [65536 + (a != b) for a, b in zip(w, w[1:])]

    raw, good = Counter(), Counter()
    for d, t in docs.items():
        c = Counter(grams(t)) if t else Counter()
        raw.update(c)
        if labels.get(d) == 1:
            good.update(c)
    n, m = (sum(c.values()) + 65538 for c in (raw, good))
    keys = {}
    for d, t in docs.items():
        g = grams(t) if t else []
        weight = 64 * sum(math.log((good[x] + 1) / m) - math.log((raw[x] + 1) / n) for x in g) / len(g) if g else 0.0
        h = xxhash.xxh64_intdigest(b"gumbel", xxhash.xxh64_intdigest(d.to_bytes(8, "little"), 42))
        keys[d] = weight - math.log(-math.log(((h >> 12) + 0.5) / 2**52))
    k = round(sum(q == 1 for q in labels.values()) / len(labels) * len(docs))
    last = sorted(keys.values())[-k]
    return {d: t for d, t in docs.items() if keys[d] >= last}


def brute_lines(docs):
    def near(a, b):
        most = min(2, int(0.2 * max(len(a), len(b)) + 1e-9))
        if abs(len(a) - len(b)) > most:
            return False
        row = {0: 0} | {j: j for j in range(1, most + 1)}
        for i, c in enumerate(a, 1):
            row = {j: min(row.get(j, 99) + 1, row.get(j - 1, 99) + (j > 0 and c != b[j - 1]) if j else 99, 99) for j in range(max(0, i - most), min(len(b), i + most) + 1)}
            for j in sorted(row):
                row[j] = min(row[j], row.get(j - 1, 99) + 1)
            if min(row.values()) > most:
                return False
        return row.get(len(b), 99) <= most

    kinds = sorted({x for t in docs.values() for x in t.split("\n") if x.strip(" ")}, key=len)
    of, seen, out = dict(zip(kinds, classes(kinds, near))), set(), {}
    for d, t in sorted(docs.items()):
        kept = []
        for x in t.split("\n"):
            if not x.strip(" ") or of[x] not in seen:
                kept.append(x)
            if x.strip(" "):
                seen.add(of[x])
        if "".join(kept).strip(" ") or not t.strip(" \n"):
            out[d] = "\n".join(kept)
    return out


def brute_copies(docs):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [(d, shingles(t)) for d, t in sorted(docs.items())]
    alike = lambda a, b: 5 * len(a[1] & b[1]) >= 4 * len(a[1] | b[1])
    return {d: docs[d] for (d, _), (c, _) in zip(sets, [sets[r] for r in classes(sets, alike)]) if d == c}


def brute_benchmarks(docs, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    windows = {tuple(w[k : k + 8]) for t in items for w in [cut(t)] for k in range(max(1, len(w) - 7)) if w}
    dirty = lambda w: any(tuple(w[k : k + n]) in windows for n in {len(x) for x in windows} for k in range(len(w) - n + 1))
    return {d: t for d, t in docs.items() if not dirty(cut(t))}


def test_run_by_brute_force(spark):
    read = lambda n: spark.read.parquet(f"{SF}/{n}.parquet").collect()
    rows = {r.doc_id: r for r in read("documents")}
    docs = brute_quality({d: r.text for d, r in rows.items()}, {r.doc_id: r.quality for r in read("labels")})
    lines = brute_lines(docs)
    docs = brute_benchmarks(brute_copies(lines), [r.text for r in read("benchmark")])
    sp, before = sentencepiece.SentencePieceProcessor(model_file=PIECES), base.made()
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(docs)
    assert all((r.text, r.n_tokens, r.n_chars, r.lang, r.source) == (sp.decode(sp.encode(docs[d])), len(sp.encode(docs[d])), len(docs[d]), rows[d].lang, rows[d].source) for d, r in got.items())
    assert all("stage-" in path for path in base.made() - before)


def test_stages_on_awkward_rows(spark, tmp_path):
    """Nulls in every column, empty and repeated rows, clashing names, empty tables."""
    schema = "doc_id long, text string, lang string, source string, n_chars int, key double, stay string, n_tokens int, id long, fp string, _n int"
    text = "some words that stand here for a text of some length, line one\nand a second line"
    rows = [(1, text, "en", "a", 80, 1.0, "x", 1, 1, "f", 1), (1, text, "en", "a", 80, 1.0, "x", 1, 1, "f", 1), (2, None, None, None, None, None, None, None, None, None, None), (None, "a text without an id that says other things", None, None, 5, None, None, None, None, None, None), (3, "", "fr", "b", 0, 2.0, "y", 2, 2, "g", 2), (4, "x " * 100_000, "de", "c", 200_000, 3.0, "z", 3, 3, "h", 3)]
    spark.createDataFrame([(1, 1, 0), (4, None, None), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing that occurs"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert sorted(out.columns) == sorted(docs.columns), name
        got = out.collect()
        assert {r.doc_id for r in got} >= {1, 4} and len(got) >= 3, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
