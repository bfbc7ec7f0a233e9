"""The training-data operators against brute force on small tables with awkward rows."""

import base64
import hashlib
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
import tokenizers
import xxhash
from pyspark.sql import functions as F

from pixelloom.llm import base, components, decontamination, fingerprints, importance, induced_sort, language_id, line_dedup, piece_codec, simhash_dedup, suffix_dedup, token_counts, token_files
from pixelloom.llm.queries import BYTES, PIECES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, stay string, u int, bytes binary"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out = [words(rng, rng.randint(1, 120)) + "\n" + words(rng, rng.randint(1, 30)) for _ in range(24)]
    out += [out[0], out[0], out[3] + " x", out[1][:300] + " tail words here", out[2].replace("a", "b", 1), "", " ", None, None, "\n\n", "é" * 90 + " Straße ÉÈ", "日本語 " * 40, "👍🏽" * 30]
    out += [out[4] + "\n" + out[5], "  two  spaces  ", "a\x00b <|endoftext|> <s>", "▁x ▁▁ y", "A, b.c; d's\tq\r\nz", words(rng, 9000), "ab" * 400, "ab" * 400 + "c", "Hello there, General " * 30]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 2 else "fr", "s", len(t or ""), i, "s", 1, b"") for i, t in texts]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_token_counts(docs, texts, empty):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = by_id(token_counts.token_counts(docs, PIECES, limit=100))
    for i, t in texts:
        n = len(sp.encode(t or ""))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 100)
    hf = tokenizers.Tokenizer.from_file(BYTES)
    got = by_id(token_counts.token_counts(docs, BYTES))
    assert all(got[i].n_tokens == len(hf.encode(t or "", add_special_tokens=False).ids) for i, t in texts)
    assert token_counts.token_counts(empty, PIECES).count() == 0


def test_pieces(docs, texts, empty):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = by_id(piece_codec.round_trip(docs, PIECES))
    for i, t in texts:
        ids = [sp.bos_id(), *sp.encode(t or ""), sp.eos_id()]
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and got[i].n_tokens == len(ids)
        assert got[i].decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    back = by_id(piece_codec.decode(piece_codec.encode(docs, PIECES), PIECES))
    assert back[0].text == texts[0][1]
    again = piece_codec.reencode_texts(docs, PIECES)
    assert again.columns == [*docs.columns, "n_tokens"] and by_id(again)[texts[31][0]].text is None
    assert piece_codec.round_trip(empty, PIECES).count() == 0


def test_agenda_equals_the_library():
    sp, own, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_codec.Agenda(PIECES), random.Random(3)
    for _ in range(300):
        w = "".join(rng.choice("etaoinshrdluéß日.,!7Z") for _ in range(rng.randint(1, 40)))
        assert own.encode("▁" + w) == sp.encode(w)
    w = "tion" * 5000
    assert own.encode("▁" + w) == sp.encode(w)


def test_token_files(spark, docs, texts, empty):
    hf = tokenizers.Tokenizer.from_file(BYTES)
    got, start = by_id(token_files.token_digests(docs, BYTES)), 0
    for i, t in texts:
        ids = [*hf.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_files.token_digests(empty, BYTES).count() == 0


def test_token_files_keep_order_and_columns(spark, docs):
    out = base.shared_path(spark, "tokens")
    token_files.write_tokens(docs, BYTES, out, files=3)
    t = token_files.read_tokens(spark, out)
    ordered = [r.doc_id for r in t.select("doc_id", "file", "row").orderBy("file", "row").collect()]
    assert ordered == sorted(ordered)
    plan = t.select("doc_id", "n_tokens")._jdf.queryExecution().toString()
    assert "ids" not in plan.split("ReadSchema")[-1]


def test_token_ids_of_every_code_point():
    """The library decides what a letter is; no Unicode table of another version has a say."""
    own = token_files.ids_of(BYTES)
    points = [chr(c) for c in range(0x33480) if not 0xD800 <= c < 0xE000]
    for form in ("x{}'re", "a {} b\n{} c,{}."):
        texts = [form.replace("{}", c) for c in points]
        want = [e.ids for e in own.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        for at in range(0, len(texts), 50_000):
            ids, n = own.encode(pa.array(texts[at : at + 50_000]))
            assert n.tolist() == [len(w) for w in want[at : at + 50_000]] and ids.tolist() == [i for w in want[at : at + 50_000] for i in w]


def test_token_ids_of_awkward_texts():
    own, rng = token_files.ids_of(BYTES), random.Random(8)
    bits = [" ", "\n", ",", ".", "'s", "a", "B", "9", " x", "é", "\t", "\x1f", "\u3000", "日", "👍", "<|endoftext|>", "!", "\0", "\u0345", "ſ", "\xa0", "\ufeff"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(40_000)] + ["word " * 100_000, "x" * 200_000]
    ids, n = own.encode(pa.array(texts))
    want = [e.ids for e in own.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_token_files_read_ranges(spark, docs, texts):
    out = base.shared_path(spark, "tokens")
    token_files.write_tokens(docs, BYTES, out, files=3)
    hf = tokenizers.Tokenizer.from_file(BYTES)
    whole = [i for _, t in texts for i in [*hf.encode(t or "", add_special_tokens=False).ids, 2]]
    for start, stop in ((0, 10), (500, 9000), (len(whole) - 5, len(whole) + 100), (7, 7)):
        rows = token_files.read_range(spark, out, start, stop).orderBy("start").collect()
        assert [i for r in rows for i in r.ids] == whole[start:stop] and (not rows or rows[0].start == start)
    assert token_files.file_number("part-100000-x.parquet") > token_files.file_number("part-99999-x.parquet")


def test_token_files_have_the_set_format(spark, docs):
    out = base.shared_path(spark, "tokens")
    token_files.write_tokens(docs, BYTES, out, files=2)
    for f in Path(out.removeprefix("file:")).glob("part-*.parquet"):
        about = pq.ParquetFile(f).metadata
        column = about.row_group(0).column(about.num_columns - 1)
        assert set(column.encodings) & {"RLE_DICTIONARY", "DELTA_BINARY_PACKED"} and column.has_offset_index and column.has_column_index
        assert all(about.row_group(g).total_byte_size <= 2 * token_files.ROW_GROUP_BYTES for g in range(about.num_row_groups))


def test_equal_ids_follow_by_text(spark):
    rows = [(5, "b b"), (5, "a"), (5, None), (2, "z")]
    got = token_files.token_digests(spark.createDataFrame(rows, "doc_id long, text string"), BYTES).orderBy("start").collect()
    assert [(r.doc_id, r.n_tokens) for r in got] == [(2, 2), (5, 1), (5, 2), (5, 3)]


def test_winnowing_guarantee():
    rng = random.Random(9)
    shared = "".join(rng.choice("abcdef ") for _ in range(fingerprints.GRAM + fingerprints.WINDOW - 1))
    for _ in range(50):
        a, b = (words(rng, 40) + shared + words(rng, 30) for _ in range(2))
        assert set(fingerprints.winnow(fingerprints.points_of(a))[0].tolist()) & set(fingerprints.winnow(fingerprints.points_of(b))[0].tolist())


@pytest.mark.parametrize("text", ["abcabcabcabcabcabcabcabcabcabc" * 4, "a" * 100, "xyz", "", "hello world, this is a text of some length for windows"])
def test_winnowing_picks_the_rightmost(text):
    pts = fingerprints.points_of(text)
    h, at = fingerprints.winnow(pts)
    if not text:
        assert len(h) == 0
        return
    k = min(fingerprints.GRAM, len(pts))
    g = fingerprints.gram_hashes(pts, k)
    assert all(len({tuple(pts[i : i + k]) for i in np.flatnonzero(g == v)}) == 1 for v in g)
    w = min(fingerprints.WINDOW, len(g))
    want = sorted({max(j for j in range(i, i + w) if g[j] == g[i : i + w].min()) for i in range(len(g) - w + 1)})
    assert at.tolist() == want


def brute_winnow(t):
    """The smallest hash of every window, by plain integers; equal hashes need no place here."""
    k = min(fingerprints.GRAM, len(t))
    hashes = []
    for a in range(len(t) - k + 1) if t else []:
        h = 0
        for c in t[a : a + k]:
            h = (h * int(fingerprints.BASE) + ord(c) + 1) % (1 << 64)
        hashes.append(((h ^ h >> 32) * int(fingerprints.MIX) % (1 << 64)) >> 32)
    w = min(fingerprints.WINDOW, len(hashes))
    return {min(hashes[a : a + w]) for a in range(len(hashes) - w + 1)} if hashes else set()


def text_of(hashes):
    return base64.b64encode(b"".join(h.to_bytes(4, "little") for h in sorted(hashes))).decode()


def test_edited_likeness(docs, texts, empty):
    got = by_id(fingerprints.edited_likeness(docs))
    assert len(got) == len(texts)
    for n, (i, t) in enumerate(texts):
        t, then = t or "", texts[(n + 1) % len(texts)][1] or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + then[:cut]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        own, other, mixed = brute_winnow(t), brute_winnow(then), brute_winnow(edited)
        like = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
        assert got[i].fingerprint == text_of(own) and got[i].edited_fingerprint == text_of(mixed)
        assert got[i].near_edited == like(own, mixed) and got[i].near_next == like(own, other)
        if t == then:
            assert got[i].near_next == 1
    assert got[0].fingerprint == got[24].fingerprint
    assert fingerprints.edited_likeness(empty).count() == 0
    assert fingerprints.winnowed(docs).count() == len(texts)


def test_edited_likeness_of_one(spark):
    r = fingerprints.edited_likeness(spark.createDataFrame([(7, "abcdefgh")], "doc_id long, text string")).first()
    assert r.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and r.near_next == 1


def brute_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i + 1, n):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash(docs, texts, empty):
    got = by_id(simhash_dedup.near_duplicates(docs))
    f = [brute_fingerprint(t or "") for _, t in texts]
    assert [got[i].fp % (1 << 64) for i, _ in texts] == f
    assert [got[i].component_id for i, _ in texts] == classes(len(f), lambda i, j: (f[i] ^ f[j]).bit_count() <= 4)
    assert simhash_dedup.near_duplicates(empty).count() == 0
    kept = simhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(r.component_id for r in got.values()))


@pytest.mark.parametrize(("hot", "trees"), [(8, 0), (8, 1 << 20), (2, 1 << 20), (4096, 0)])
def test_bk_links_join_the_right_classes(spark, hot, trees, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "TREE_BYTES", trees)
    rng = random.Random(11)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps)[:20]:
        for _ in range(6):
            fps.add(f := f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, n) for n, f in enumerate(fps)], "fp long, node long")
    roots = {r.node: r.root for r in components.components(simhash_dedup.links(df, 4, hot)).collect()}
    assert [roots.get(n, n) for n in range(len(fps))] == classes(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)


def test_more_blocks_keep_all_links():
    rng = random.Random(4)
    for m in (5, 6, 7):
        masks = simhash_dedup.shard_masks(m, 4)
        for _ in range(200):
            a = rng.getrandbits(64)
            b = a ^ sum(1 << k for k in rng.sample(range(64), 4))
            assert any(a & x == b & x for x in masks)
    assert simhash_dedup.blocks_for(10**9, 4) > 5


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(100, 400)] + [(5, 6), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components.components(chain).collect()}
    assert got == {i: 100 for i in range(100, 401)} | {5: 5, 6: 5}


def brute_lines(texts, tau):
    occ = [(i, n, x) for i, t in texts for n, x in enumerate((t or "").split("\n")) if x.strip(" ")]
    kinds = sorted({x for _, _, x in occ})

    def edits(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
            p = q
        return p[-1]

    near = lambda i, j: abs(len(kinds[i]) - len(kinds[j])) <= 2 and max(len(kinds[i]), len(kinds[j])) < 3000 and edits(kinds[i], kinds[j]) <= line_dedup.allowed(len(kinds[i]), len(kinds[j]), tau)
    cls, seen, keep = dict(zip(kinds, classes(len(kinds), near))), set(), {}
    for i, n, x in occ:
        if cls[x] not in seen:
            seen.add(cls[x])
            keep.setdefault(i, []).append(n)
    return {i: line_dedup.kept_text(t or "", keep.get(i)) for i, t in texts}


def test_line_dedup(spark, docs, texts, empty):
    want, got = brute_lines(texts, 2), by_id(line_dedup.line_digests(docs))
    for i, (text, n, removed) in want.items():
        assert (got[i].n_lines, got[i].n_removed, got[i].kept_sha256) == (n, removed, hashlib.sha256(text.encode()).hexdigest())
    assert sum(r for _, _, r in want.values()) > 0
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns
    left = by_id(out)
    assert 24 not in left and left[0].text == want[0][0] and left[31].text is None and left[29].text == ""
    assert line_dedup.line_digests(empty).count() == 0


def test_line_dedup_in_a_hot_group(spark):
    rng, stem = random.Random(6), "the same long beginning of every line in this group, then "
    lines = [stem + words(rng, 6) for _ in range(700)]
    lines += [x[:-1] + "#" for x in lines[::9]]
    rows = list(enumerate(lines))
    got, want = by_id(line_dedup.line_digests(spark.createDataFrame(rows, "doc_id long, text string"))), None
    near = {i for i, x in rows if x.endswith("#")}
    assert {i for i, r in got.items() if r.n_removed} == near and want is None


def test_hot_keys_are_split_without_loss():
    """Lines within the edits still share a key when every key is hot."""
    rng = random.Random(17)
    for _ in range(400):
        a = "".join(rng.choice("abcd") for _ in range(rng.randint(9, 40)))
        b = list(a)
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(b))
            b[at : at + 1] = rng.choice([[], [rng.choice("abcd")], [b[at], rng.choice("abcd")]])
        b = "".join(b)
        plain = [line_dedup.signatures(x, 2) for x in (a, b)]
        hot = frozenset(k & ~1 for x in plain for k in x)
        a, b = (line_dedup.signatures(x, 2, hot) for x in (a, b))
        sides = [{k & ~1 for k in x if k & 1 == side} for x in (a, b) for side in (0, 1)]
        assert sides[0] & sides[3] or sides[2] & sides[1]


def test_line_dedup_with_hot_keys(docs, texts, monkeypatch):
    want = by_id(line_dedup.line_digests(docs))
    monkeypatch.setattr(line_dedup, "ONE_IN", 1)
    monkeypatch.setattr(line_dedup, "CELL", 0)
    assert line_dedup.hot_keys(base.id_and_text(docs), 2)
    monkeypatch.setattr(line_dedup, "hot_keys", lambda d, tau, found=line_dedup.hot_keys(base.id_and_text(docs), 2): found)
    monkeypatch.setattr(line_dedup, "CELL", 256)
    assert by_id(line_dedup.line_digests(docs)) == want


def test_line_dedup_of_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a line that is here twice", 5, "x", 1.0), (2, "a line that is here twice\nother", 6, "y", 2.0)], "doc_id long, text string, stay int, of string, _stay double")
    assert [(r.doc_id, r.text, r.stay, r.of, r._stay) for r in line_dedup.dedup_lines(docs).orderBy("doc_id").collect()] == [(1, "a line that is here twice", 5, "x", 1.0), (2, "other", 6, "y", 2.0)]


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_banded_edits(most):
    rng = random.Random(most)
    for _ in range(1500):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 12)))
        b = "".join(c for c in a if rng.random() > 0.15) + "c" * rng.randint(0, 2)
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
            p = q
        assert line_dedup.within(a, b, most) == (p[-1] <= most)


def brute_cut(rows, length=50):
    first, out = {}, {}
    for i, t in sorted(rows):
        b = t.encode()
        cover = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if first.setdefault(b[k : k + length], i) < i:
                cover[k : k + length] = True
        kept = np.frombuffer(b, np.uint8)[~cover].tobytes()
        out[i] = (len(b), int(cover.sum()), int((cover & ~np.r_[False, cover[:-1]]).sum()) if len(b) else 0, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(docs, texts, empty):
    got, want = by_id(suffix_dedup.removal_digests(docs)), brute_cut([(i, t or "") for i, t in texts])
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == want
    assert sum(w[1] for w in want.values()) > 0
    assert suffix_dedup.removal_digests(empty).count() == 0


def test_suffix_dedup_without_broadcast(docs, texts, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BROADCAST_IDS", 0)
    want = brute_cut([(i, t or "") for i, t in texts])
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removal_digests(docs).collect()} == want


def test_suffix_dedup_of_equal_and_null_ids(spark):
    rows = [(1, "q" * 30 + "shared passage that is certainly longer than fifty bytes, yes"), (1, "shared passage that is certainly longer than fifty bytes, yes"), (None, "shared passage that is certainly longer than fifty bytes, yes")]
    assert all(r.n_removed == 0 for r in suffix_dedup.removal_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect())


@pytest.mark.parametrize("symbols", [1, 5, 1024])
@pytest.mark.parametrize(("budget", "chunk"), [(64, 3), (3000, 17), (1 << 26, 1 << 20)])
def test_induced_sort(symbols, budget, chunk, monkeypatch):
    monkeypatch.setattr(induced_sort, "SYMBOLS", symbols)
    monkeypatch.setattr(induced_sort, "CHUNK", chunk)
    monkeypatch.setattr(induced_sort, "WINDOW", chunk)
    rng = random.Random(8)
    for _ in range(60):
        t = [rng.randint(1, rng.choice([1, 2, 4, 30])) for _ in range(rng.randint(0, 120))]
        t = t + t[: len(t) // 2] + t + [0]
        depth, space = rng.choice([3, 7, 50]), induced_sort.Space(budget)
        order, prefix = induced_sort.suffix_order(np.array(t), depth, space)
        assert sorted(order.tolist()) == list(range(len(t))) and (space.on_disk > 0 or budget > 64 or len(t) < 10)
        for a, b, n in zip(order[:-1], order[1:], prefix[1:]):
            x, y = t[a:], t[b:]
            common = next((k for k in range(min(len(x), len(y), depth)) if x[k] != y[k]), min(len(x), len(y), depth))
            assert x[:depth] <= y[:depth] and n == common


def test_induced_sort_beyond_memory(monkeypatch):
    """A sequence whose arrays are far larger than the budget goes to disk, through recursion, and comes out the same."""
    rng = random.Random(14)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(900)]
    raw = " ".join(rng.choice(vocabulary) for _ in range(30_000)).encode()
    text = np.append(np.frombuffer(raw, np.uint8).astype(np.int16) + 2, 0).astype(np.int16)
    order, prefix = induced_sort.suffix_order(text, 50)
    levels, inner, peaks = [], induced_sort.suffix_order, []

    def counted(t, depth, space=None, exact=True):
        levels.append(len(t))
        peaks.append(space.budget // 2 - space.left)
        return inner(t, depth, space, exact)

    monkeypatch.setattr(induced_sort, "suffix_order", counted)
    monkeypatch.setattr(induced_sort, "CHUNK", 1 << 12)
    monkeypatch.setattr(induced_sort, "WINDOW", 1 << 12)
    space = induced_sort.Space(60_000)
    far, far_prefix = induced_sort.suffix_order(text, 50, space)
    assert len(levels) > 2 and space.on_disk > 10 * space.budget and max(peaks) <= space.budget // 2
    assert isinstance(far, np.memmap) and (far_prefix == prefix).all()
    cut = np.flatnonzero(prefix < 50)
    assert all(set(a) == set(b) for a, b in zip(np.split(far, cut), np.split(order, cut)))


def test_runs_of_a_shard_beyond_memory(monkeypatch):
    rng = random.Random(15)
    pieces = [words(rng, 40).encode() for _ in range(30)]
    stretches = [b" ".join(rng.choice(pieces) for _ in range(3)) for _ in range(200)]
    docs = np.array([rng.randint(0, 50) for _ in stretches])
    want = {}
    for s, d in zip(stretches, docs.tolist()):
        for k in range(len(s) - 49):
            want[s[k : k + 50]] = min(want.get(s[k : k + 50], d), d)
    for budget, chunk in ((5000, 100), (1 << 26, 1 << 20)):
        monkeypatch.setattr(induced_sort, "CHUNK", chunk)
        space = induced_sort.Space(budget)
        got = {}
        for i, a, b, d in zip(*(x.tolist() for x in suffix_dedup.first_runs(stretches, docs, 50, space))):
            got |= {(i, k): d for k in range(a, b + 1)}
        assert got == {(i, k): want[s[k : k + 50]] for i, s in enumerate(stretches) for k in range(len(s) - 49)}
        assert (space.on_disk > 20 * budget) == (budget == 5000)


def brute_hits(texts, items, width=8):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    out = {}
    for i, t in texts:
        w, hit, found = cut(t), set(), set()
        for item, x in items:
            v = cut(x)
            for s in [v[k : k + width] for k in range(max(1, len(v) - width + 1))] if v else []:
                for k in range(len(w) - len(s) + 1):
                    if w[k : k + len(s)] == s:
                        hit.update(range(k, k + len(s)))
                        found.add(str(item))
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2)
    return out


def test_decontamination(spark, docs, texts, empty):
    t = dict(texts)
    items = [(1, " ".join(t[0].split()[5:30])), (2, " ".join(t[0].split()[20:40]).upper()), (3, "straße éè"), (4, "Straße ÉÈ"), (5, ""), (6, None), (10, "general hello"), (11, " ".join(t[6].split()[:8])), (12, "nowhere to be found at all in these texts today")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got, want = by_id(decontamination.contamination(docs, bench)), brute_hits(texts, items)
    assert {i: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for i, r in got.items()} == want
    assert any(w[4] for w in want.values()) and any(w[2] == 1 for w in want.values())
    assert decontamination.contamination(empty, bench).count() == 0
    assert by_id(decontamination.contamination(docs, bench.limit(0)))[0].n_items == 0
    left = decontamination.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, w in want.items() if not w[2]}


@pytest.mark.parametrize("limit", [0, 8 << 20])
def test_decontamination_without_broadcast(spark, docs, texts, monkeypatch, limit):
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", limit)
    t = dict(texts)
    items = [(1, " ".join(t[0].split()[5:30])), (2, "nothing of this"), (3, " ".join(t[4].split()[3:9])), (4, t[34][:500])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got, want = by_id(decontamination.contamination(docs, bench)), brute_hits(texts, items)
    assert {i: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for i, r in got.items()} == want


def test_texts_with_one_id_are_matched_apart(spark):
    docs = spark.createDataFrame([(1, "one two three four"), (1, "x x x x five six seven eight"), (2, "one two three four five six seven eight")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "one two three four five six seven eight")], "item_id long, text string")
    got = {(r.doc_id, r.n_words): r.n_hit for r in decontamination.contamination(docs, items).collect()}
    assert got == {(1, 4): 0, (1, 8): 0, (2, 8): 8}


@pytest.mark.parametrize("limit", [0, 8 << 20])
def test_proximity(spark, monkeypatch, limit):
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", limit)
    docs = spark.createDataFrame([(1, "alpha x beta gamma"), (2, "gamma beta alpha"), (3, "alpha z z z z z beta gamma"), (None, "Beta y gamma q alpha")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "alpha beta gamma"), (10, "gamma"), (11, "nowhere gamma")], "item_id long, text string")
    index = decontamination.build_index(docs)
    near = decontamination.proximity_matches(index, items, slop=2).collect()
    assert {r.doc_id for r in near if 9 in r["items"]} == {1, 2, None} and {r.doc_id for r in near if 10 in r["items"]} == {1, 2, 3, None}
    assert {r.doc_id for r in decontamination.matches(index, decontamination.test_phrases(index, items)[1]).collect()} == {1, 2, 3, None}


def test_language_id(spark, docs, empty):
    rng = random.Random(2)
    rows = [(i, " ".join("".join(rng.choice(a) for _ in range(5)) for _ in range(40)), lang) for i, (lang, a) in enumerate([("xx", "abcde"), ("yy", "fghij"), ("zz", "klmno")] * 60)]
    rows += [(1000, None, "xx"), (1001, "", "xx"), (1002, "123 !!", "yy"), (1003, "abcde " * 30000, None), (1004, "fgh", "yy")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = by_id(language_id.cross_checked(df))
    for i, t, lang in rows[:180]:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and got[i].lang_pred == lang and 0.5 < got[i].score <= 1
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003, 1004)] == ["und", "und", "und", "xx", "yy"]
    assert got[1000].score == 0
    assert language_id.cross_checked(empty).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs, language_id.train(df.limit(0))).collect()} == {"und"}
    c = language_id.codewords(9)
    assert min((c[i] != c[j]).sum() for i in range(9) for j in range(i)) >= 5


def test_language_id_of_held_out_rows(spark):
    """Accuracy on rows that nothing was learned from."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got, lang = by_id(language_id.cross_checked(docs)), {r.doc_id: (r.lang, r.text) for r in docs.collect()}
    asked = [i for i, r in got.items() if r.held_out and lang[i][0] and lang[i][1] and any(map(str.isalpha, lang[i][1]))]
    assert len(asked) > 150 and sum(got[i].lang_pred == lang[i][0] for i in asked) >= 0.99 * len(asked)


def test_language_weights_by_brute_force(spark):
    rows = [(i, x, lang) for i, (x, lang) in enumerate([("abc abd", "a"), ("xyz xyz zzz", "b"), ("abx aby", "c"), ("qq", "b")])]
    m = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    p = np.full((3, language_id.BUCKETS), language_id.SMOOTHING)
    for _, x, lang in rows:
        np.add.at(p["abc".index(lang)], language_id.grams(x, lower=True), 1)
    p /= p.sum(axis=1, keepdims=True)
    code = language_id.codewords(3)
    w = np.stack([np.log(p[c > 0].mean(axis=0)) - np.log(p[c < 0].mean(axis=0)) for c in code.T], axis=1)
    trust = np.maximum(code * (p @ w), 1e-3)
    assert m.languages == ["a", "b", "c"] and np.allclose(m.weights, w, atol=1e-5) and np.allclose(m.trust, trust / trust.sum(axis=1, keepdims=True), rtol=1e-6)


def test_importance(spark, docs, empty):
    rng = random.Random(3)
    good = [(i, words(rng, 60)) for i in range(80)]
    bad = [(100 + i, " ".join(w + "%%#" for w in words(rng, 40).split())) for i in range(20)]
    rep = [(200 + i, "same " * 60) for i in range(10)]
    df = spark.createDataFrame(good + bad + rep, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 if i < 100 else 0) for i, _ in good[::2] + bad[::2] + rep[::2]], "doc_id long, quality int")
    got = by_id(importance.scores(df, labels))
    assert {i for i, r in got.items() if r.keep} == {i for i, _ in good}
    kept = importance.keep_good(df.withColumn("key", F.lit(1)), labels)
    assert kept.columns == ["doc_id", "text", "key"] and {r.doc_id for r in kept.collect()} == {i for i, _ in good}
    assert importance.scores(df, labels, k=10).where("keep").count() == 10 and importance.scores(df, labels, share=0.5).where("keep").count() == 55
    assert all(r.keep for r in importance.scores(docs, labels.limit(0)).collect())
    assert importance.scores(empty, labels).count() == 0


def test_importance_by_brute_force(spark, docs, texts):
    labels = {i: int(i % 3 > 0) for i, t in texts if i % 2}
    got = by_id(importance.scores(docs, spark.createDataFrame([*labels.items()], "doc_id long, quality int"), share=0.5))

    def grams(t):
        raw = f" {t} ".encode()
        byte = [(int.from_bytes(raw[k : k + 3], "little") * 0x9E3779B1 & 0xFFFFFFFF) >> 16 for k in range(len(raw) - 2)]
        w = t.split()
        return byte + [65536 + (a != b) for a, b in zip(w, w[1:])]

    counts = [[1.0] * 65538 for _ in range(2)]
    for i, t in texts:
        for g in grams(t) if t else []:
            counts[0][g] += 1
            counts[1][g] += labels.get(i) == 1
    total = [sum(c) for c in counts]
    keys = {}
    for i, t in texts:
        ratio = [np.log(counts[1][g] / total[1]) - np.log(counts[0][g] / total[0]) for g in grams(t)] if t else [0.0]
        assert abs(got[i].log_weight - 64 * sum(ratio) / len(ratio)) < 1e-6
        keys[i] = got[i].key
    noise = [got[i].key - got[i].log_weight for i, _ in texts]
    assert -3 < min(noise) < 0 < max(noise) < 12 and len(set(noise)) == len(noise)
    last = sorted(keys.values())[-round(0.5 * len(keys))]
    assert all(got[i].keep == (keys[i] >= last) for i in keys)


def test_gumbel_sampling_follows_the_weights(spark):
    """Of documents with two weights, one by one in proportion to exp(weight)."""
    ids = spark.range(200_000).withColumnRenamed("id", "doc_id")
    noise = ids.select((F.col("doc_id") % 2).alias("heavy"), (importance.gumbel(F.col("doc_id")) + F.when(F.col("doc_id") % 2 == 1, 1.0).otherwise(0.0)).alias("key"))
    top = noise.orderBy(F.desc("key")).limit(2000).groupBy("heavy").count().collect()
    n = {r.heavy: r["count"] for r in top}
    assert 0.68 < n[1] / 2000 < 0.78  # e / (1 + e) = 0.73


def test_kth_largest(spark):
    rng = random.Random(1)
    v = [rng.gauss(0, 1e6) for _ in range(500)] + [1.5] * 40
    df = spark.createDataFrame([(x,) for x in v], "v double")
    for k in (1, 2, 100, 269, 540, 900):
        assert importance.kth_largest(df, "v", k) == sorted(v, reverse=True)[min(k, len(v)) - 1]
    assert importance.kth_largest(df, "v", 0) is None


def test_null_ids(spark):
    rows = [(None, "a line that comes twice here\nown line of the first", None), (None, None, None), (3, "a line that comes twice here", None), (4, "item words are one two three four five six seven eight", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    lines = sorted(line_dedup.line_digests(docs).collect(), key=lambda r: (r.doc_id or 0, r.n_lines))
    assert [r.n_removed for r in lines] == [0, 0, 1, 0]
    bench = spark.createDataFrame([(1, "own line of the first"), (None, "one two three four five six seven eight"), (2, "one two three four five six seven")], "item_id long, text string")
    hit = {(r.doc_id, r.n_words): r.n_hit for r in decontamination.contamination(docs, bench).collect()}
    assert hit[None, 11] == 5 and hit[4, 11] == 8
    assert decontamination.drop_contaminated(docs, bench).where("doc_id = 4").count() == 0
    for df in (token_counts.token_counts(docs, PIECES), token_files.token_digests(docs, BYTES), piece_codec.round_trip(docs, PIECES), fingerprints.edited_likeness(docs), suffix_dedup.removal_digests(docs), language_id.cross_checked(docs), simhash_dedup.near_duplicates(docs)):
        assert len(df.collect()) == 4
    labels = spark.createDataFrame([(None, 1), (4, None), (3, 1)], "doc_id long, quality int")
    assert importance.scores(docs, labels).count() == 4 and importance.keep_good(docs, labels).count() > 0


def test_a_very_long_text(spark):
    rng = random.Random(12)
    long = "\n".join(words(rng, 40) for _ in range(900))
    docs = spark.createDataFrame([(1, long), (2, long[1000:] + " end"), (3, "x" * 200_000)], "doc_id long, text string")
    got = by_id(suffix_dedup.removal_digests(docs))
    assert got[2].n_removed >= len(long) - 1000 - 49 and got[3].n_removed == 0
    assert by_id(line_dedup.line_digests(docs))[2].n_removed >= 890
    assert by_id(token_counts.token_counts(docs, PIECES))[3].n_tokens == len(sentencepiece.SentencePieceProcessor(model_file=PIECES).encode("x" * 200_000))
