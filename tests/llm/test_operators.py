"""The corpus operators against brute force, round trips and awkward tables."""

from __future__ import annotations

import hashlib
import random
from collections import Counter
from datetime import datetime, timedelta
from itertools import pairwise

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from dendrolith.llm import backoff, bpe, hamming_search, html, mixing, perplexity, quality, registry, repeats, sharding, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, h string, fp string, size string, grp string, score string, pattern string"


def rows_of(seed: int = 3, n: int = 60) -> list[tuple]:
    """Awkward documents: nulls, blanks, ties, repeated rows, near copies, shared passages, a long text."""
    rng = random.Random(seed)
    words = ["the", "of", "and", "ering", "thati", "nd", "été", "größe", "niño", "cat", "dog", "run", "x1"]
    prose = lambda m: " ".join(rng.choice(words) + rng.choice("abcdefgh") * rng.randint(0, 3) for _ in range(m))
    passage, base = prose(60), prose(200)
    out = []
    for i in range(n):
        text = prose(rng.randint(5, 120))
        if i % 5 == 0:
            text = text + "\n" + passage + "\n" + prose(10)
        if i % 7 == 0:
            text = base if i % 14 else base + " tail" + str(i)
        out.append((i, text))
    out += [(100, None), (101, ""), (102, " \n\t "), (103, "one"), (104, "One two"), (None, prose(70)), (None, None), (105, base), (105, base), (106, "aaaa" * 100), (107, "ab" * 300), (108, prose(4000)), (109, "x" * 99), (110, "<|endoftext|> x <|endoftext|>")]
    return [(d, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", None, ""]), None if t is None else len(t), "K", "H", "F", "S", "G", "sc", "p") for d, t in out]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder of tables as the queries read them; extra columns have names that the operators use themselves."""
    made = {}

    def make(name: str, rows: list[tuple] | None = None) -> str:
        if name not in made:
            path = tmp_path_factory.mktemp(name)
            rows = rows_of() if rows is None else rows
            spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
            labels = [(r[0], int(i % 4 != 0), 0) for i, r in enumerate(rows) if r[0] is not None] + [(None, 1, 0)] * bool(rows) + [(3, None, 0)] * bool(rows)
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
            pages = [(1, "u", PAGE), (2, "v", None), (3, None, ""), (None, "w", "<p>unclosed <b>x &amp; y"), (1, "u", PAGE)] if rows else []
            spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
            rng = np.random.default_rng(1)
            vectors = [(i, [float(x) for x in rng.standard_normal(64)], 0) for i in range(150)] + [(200, None, 1), (220, [], 1), (None, [1.0] * 64, 1), (240, [1.0, float("nan"), None] * 20, 1)] + [(300 + i, [1.0] * 64, 2) for i in range(30)] + [(20, [float(x) for x in rng.standard_normal(64)], 0)]
            spark.createDataFrame(vectors if rows else [], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
            at = datetime(2024, 1, 2)
            shop = {
                "clicks": ([(1, at, at, 7, "purchase", 1.5, "{}"), (1, at, at, 7, "purchase", 1.5, "{}"), (None, None, at, None, None, None, None)], "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"),
                "sales": ([(1, 7, "done", 2.0, at, at, 1), (2, 7, "open", None, at + timedelta(days=3), None, 1), (None, None, None, None, None, None, None)], "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int"),
                "sale_lines": ([(1, 1, 5, 3.0, at), (1, 1, 5, 3.0, at), (1, 2, None, None, None), (None, 1, 5, 1.0, at)], "sale_id long, line_no int, item_id long, amount double, shipped_at timestamp_ntz"),
            }
            for t, (facts, schema) in shop.items():
                spark.createDataFrame(facts if rows else [], schema).write.parquet(f"{path}/{t}.parquet")
            made[name] = str(path)
        return made[name]

    return make


PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body><header>Site</header>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy now, a long enough advert text to look like prose here.</div>
<main><article><h1>A  title</h1><p>First paragraph with &eacute;t&eacute; and enough words to be content, really.</p><p>Short.</p>
<aside>Related things</aside><form><input value="x">Search</form><div id="comments"><p>First! I liked this very much indeed, thanks.</p></div></article></main>
<div class="cookie-notice">We use cookies and need you to accept them all.</div><footer>(c) x</footer></body>"""


def run(spark, name: str, path: str) -> pd.DataFrame:
    return registry.queries()[name](spark, path).toPandas()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_empty_tables(spark, folder, name):
    assert len(run(spark, name, folder("empty", []))) == 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql_agrees(spark, name):
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in ("documents", "embeddings", "clicks", "sales", "sale_lines"):
        con.execute(f"create view {t} as select * from '{path}/{t}.parquet'")
    want, got = con.execute(registry.oracle_sql()[name]).df(), run(spark, name, path)
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    plain = lambda df: df[cols].astype({c: "float64" for c in cols if str(df[c].dtype) == "Int64"}).sort_values(cols, ignore_index=True)  # noqa: E731  nulls among whole numbers
    pd.testing.assert_frame_equal(plain(want), plain(got))


# 1 sharding


@settings(max_examples=40, deadline=None)
@given(n=st.integers(1, 3000), seed=st.integers(0, 1 << 60))
def test_permutation_is_a_bijection(n, seed):
    p = sharding.FeistelPermutation(n, seed)
    out = p.forward(np.arange(n))
    assert sorted(out.tolist()) == list(range(n))
    assert (p.inverse(out) == np.arange(n)).all()


def test_sharding(spark, folder):
    got = run(spark, "op1_feistel_shards", folder("docs"))
    rows = rows_of()
    assert len(got) == len(rows)
    sizes = got.groupby("shard").slot.apply(sorted)
    assert all(s == list(range(len(s))) for s in sizes)
    counts = got.groupby("shard").size().reindex(range(40), fill_value=0)
    assert counts.max() - counts.min() <= 1
    import zlib

    want = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((None if pd.isna(a) else int(a), b, c) for a, b, c in zip(got.doc_id, got["size"], got.text_crc32, strict=True)) == want
    again = run(spark, "op1_feistel_shards", folder("docs"))
    key = ["text_crc32", "size", "shard", "slot"]
    assert got[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()


# 2 near duplicates


def slow_fingerprint(text: str | None) -> int:
    words = (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps: list[int], radius: int = 2) -> list[int]:
    parent = list(range(len(fps)))

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_simhash(spark, folder):
    got = run(spark, "op2_simhash_near_duplicates", folder("docs"))
    rows = rows_of()
    fps = [slow_fingerprint(r[1]) for r in rows]
    parts = slow_components(fps)
    least = {}
    for r, c in zip(rows, parts, strict=True):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    want = Counter((r[0], f"{f:016x}", least.get(c)) for r, f, c in zip(rows, fps, parts, strict=True))
    none = lambda x: None if pd.isna(x) else int(x)
    assert Counter((none(a), b, none(c)) for a, b, c in zip(got.doc_id, got.fingerprint, got.component_id, strict=True)) == want


@pytest.mark.parametrize("hot", [4096, 3])
def test_near_links_keep_components(spark, monkeypatch, hot):
    """Families of near copies, also when every key is crowded."""
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = random.Random(hot)
    fps = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        fps.add(base)
        for _ in range(25):
            fps.add(base ^ (1 << rng.randrange(64)) ^ (rng.choice([0, 1]) << rng.randrange(64)))
        fps.add(base ^ (7 << rng.randrange(61)))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.near_links(spark.createDataFrame([(s,) for s in signed], "fp long")).toPandas()
    parent = {s: s for s in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in zip(links.src, links.dst, strict=True):
        parent[find(a)] = find(b)
    groups = Counter(frozenset(s for s in signed if find(s) == r) for r in {find(s) for s in signed})
    parts = slow_components(fps)
    want = Counter(frozenset(s for s, c in zip(signed, parts, strict=True) if c == r) for r in set(parts))
    assert groups == want


def test_pivot_distances_bound_hamming_distances():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    refs = simhash.pivots()
    t = simhash.pivot_table(a, refs).astype(int)
    for i in range(0, 300, 7):
        assert (np.abs(t[i] - t[i + 1 :]).max(axis=1, initial=0) <= np.bitwise_count(a[i] ^ a[i + 1 :])).all()


# 3 perplexity


def slow_base(text: str | None) -> tuple:
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line in seen and re.search(r"[^\x20\x09-\x0D]", line):
            dup += 1
        seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n\t|#é\x1c\xa0　A", max_size=80))
def test_base_counts(text):
    assert perplexity.base_counts(text.encode()) == slow_base(text)


def test_kneser_ney_normalises_and_backs_off():
    texts = [b"the cat sat on the mat and the cat ran", b"a dog and a cat", b"ab", b"", b"| # $ 12"]
    codes, counts = perplexity.ngram_codes(texts)
    assert counts.tolist() == [max(len(t) - 3, 0) for t in texts]
    found, n = np.unique(codes, return_counts=True)
    model = perplexity.kneser_ney(found, n)
    for context in (int(found[0]) // 40, int(found[len(found) // 2]) // 40, 39 * 1600 + 39 * 40 + 39):
        total = np.exp(model.log_probability(context * 40 + np.arange(40))).sum()
        assert total == pytest.approx(1.0, abs=1e-5)


def test_quality_rules(spark, folder):
    got = run(spark, "op3_kneser_ney_bands", folder("docs"))
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    want = Counter((r[0], *slow_base(r[1])) for r in rows_of())
    assert Counter((None if pd.isna(i) else int(i), *map(int, v)) for i, v in zip(got.doc_id, got[cols].values.tolist(), strict=True)) == want
    assert (got.base_failed == ((got.n_words < 50) | (100 * got.n_repeat_words > 50 * got.n_words))).all()
    assert not got[got.base_failed].kept.any()


def test_quality_rules_keep_clean_documents(spark):
    got = run(spark, "op3_kneser_ney_bands", "/root/testdata/sf0.01")
    labels = pd.read_parquet("/root/testdata/sf0.01/labels.parquet")
    both = got.merge(labels, on="doc_id")
    good, bad = both[(both.quality == 1) & ~both.base_failed], both[both.quality == 0]
    assert good.kept.mean() > 0.99
    assert bad.kept.mean() < 0.5


# 4 search


def test_search_is_exact(spark, folder):
    got = run(spark, "op4_multi_index_search", folder("docs"))
    v = spark.read.parquet(folder("docs") + "/embeddings.parquet").toPandas()
    codes = [(int(i), sum(1 << k for k, x in enumerate(e[:64]) if x is not None and x > 0)) for i, e in zip(v.vec_id, v.embedding, strict=True) if not pd.isna(i) and e is not None and len(e)]
    codes = sorted(set(codes))
    for q, code in {c for c in codes if c[0] % 20 == 0}:
        if sum(c[0] == q for c in codes) > 1:
            continue  # an id with two vectors asks twice
        near = {}
        for i, c in codes:
            d = (c ^ code).bit_count()
            near[i] = min(near.get(i, 99), d) if (i, c) in codes else d
        pairs = sorted(((c ^ code).bit_count(), i) for i, c in codes)[: hamming_search.K]
        mine = got[got.query_id == q].sort_values("rank")
        assert list(zip(mine.distance, mine.neighbor_id, strict=True)) == pairs


# 5 mixing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=12))
def test_capped_shares(sizes):
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    shares = mixing.capped_shares(sizes, weights)
    assert all(s <= 3 * n + 1e-6 for s, n in zip(shares, sizes, strict=True))
    assert sum(shares) == pytest.approx(sum(sizes), abs=1e-6)
    free = [s / w for s, w, n in zip(shares, weights, sizes, strict=True) if s < 3 * n - 1e-6]
    assert all(x == pytest.approx(free[0], abs=1e-6) for x in free)


def test_flow_serves_overlapping_sources():
    feeds = mixing.route([((0,), 100), ((0, 1), 100), ((1,), 10)], [120.0, 130.0])
    assert sum(f[0] for f in feeds[:2]) == 120
    assert feeds[1][1] + feeds[2][0] == 130
    assert sum(feeds[1]) <= 300 and feeds[2][0] <= 30
    assert sum(map(sum, feeds)) == 250


def test_mixture(spark):
    got = run(spark, "op5_flow_mixture", "/root/testdata/sf0.01")
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    both = got.merge(docs[["doc_id", "source"]], on="doc_id")
    assert (both.taken <= 3 * both["size"]).all()
    per = both.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"), most=("size", "max"))
    assert ((per.taken - per.target).abs() <= per.most).all()
    assert per.target.sum() == pytest.approx(per["size"].sum())
    again = run(spark, "op5_flow_mixture", "/root/testdata/sf0.01")
    assert got.sort_values("doc_id").values.tolist() == again.sort_values("doc_id").values.tolist()


def test_mixture_of_awkward_documents(spark, folder):
    got = run(spark, "op5_flow_mixture", folder("docs"))
    assert len(got) == len(rows_of())
    assert (got.taken % got["size"].where(got["size"] > 0, 1) == 0).all()
    assert (got.taken[got["size"] == 0] == 0).all()


# 6 repeats


def slow_cut(docs: list[tuple[int, bytes]], length: int) -> list[bytes]:
    seen, out = set(), []
    for _, text in docs:
        covered = np.zeros(len(text), dtype=bool)
        for i in range(len(text) - length + 1):
            w = text[i : i + length]
            if w in seen:
                covered[i : i + length] = True
            seen.add(w)
        out.append(bytes(b for b, c in zip(text, covered, strict=True) if not c))
    return out


def test_repeats(spark, folder):
    got = run(spark, "op6_radix_repeats", folder("docs"))
    rows = rows_of()
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    kept = slow_cut([(rows[i][0], (rows[i][1] or "").encode()) for i in order], 100)
    none = lambda x: None if pd.isna(x) else int(x)
    want = Counter((rows[i][0], len((rows[i][1] or "").encode()), hashlib.sha256(k).hexdigest()) for i, k in zip(order, kept, strict=True))
    assert Counter((none(a), b, c) for a, b, c in zip(got.doc_id, got.n_bytes, got.kept_sha256, strict=True)) == want
    assert ((got.n_removed > 0) == (got.n_spans > 0)).all()


@pytest.mark.parametrize(("hot", "alphabet"), [(5000, 2), (1, 3), (5000, 40)])
def test_repeats_in_dense_texts(spark, monkeypatch, hot, alphabet):
    """Few letters, shared pieces and crowded anchors; windows of 40 bytes."""
    monkeypatch.setattr(repeats, "HOT", hot)
    rng = random.Random(alphabet)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOP"[:alphabet]
    pieces = ["".join(rng.choice(letters) for _ in range(rng.randint(30, 90))) for _ in range(12)]
    docs = [(i, "".join(rng.choice(pieces) if rng.random() < 0.6 else "".join(rng.choice(letters) for _ in range(20)) for _ in range(8))) for i in range(40)]
    got = {r["doc_id"]: bytes(r["kept"]) for r in repeats.cut_out(spark.createDataFrame(docs, "doc_id long, text string"), 40).collect()}
    want = slow_cut([(i, t.encode()) for i, t in docs], 40)
    assert [got[i] for i, _ in docs] == want


def test_long_texts_are_cut_into_segments(monkeypatch):
    rng = random.Random(9)
    text = bytes(rng.choice(b"abcd") for _ in range(5000))
    whole = repeats.runs_of([text])
    monkeypatch.setattr(repeats, "CHUNK", 700)
    parts = repeats.runs_of([text])
    windows = lambda r: sorted((int(s) + k) for s, c in zip(r[3], r[4], strict=True) for k in range(c))
    assert windows(whole) == windows(parts) == list(range(4901))


# 7 back-off


def test_backoff_of_awkward_documents(spark, folder):
    scored = backoff.backoff_scores(spark.read.parquet(folder("docs") + "/documents.parquet"), 5).toPandas()
    rows = rows_of()
    texts = [(r[1] or "").encode().split() for r in rows]
    c = [Counter(), Counter(), Counter(), Counter()]
    for w in texts:
        for n in (1, 2, 3):
            c[n].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    total = sum(c[1].values())

    def score(w: list[bytes]) -> float:
        s = 0.0
        for i in range(len(w)):
            for n in range(min(3, i + 1), 0, -1):
                g = tuple(w[i - n + 1 : i + 1])
                back = (min(3, i + 1) - n) * np.log(0.4)
                if n == 1:
                    s += np.log(c[1][g] / total) + back
                elif c[n][g] >= 2:
                    s += np.log(c[n][g] / c[n - 1][g[:-1]]) + back
                    break
        return s

    none = lambda x: None if pd.isna(x) else int(x)
    want = Counter((r[0], len(w), round(score(w), 3)) for r, w in zip(rows, texts, strict=True))
    assert Counter((none(a), b, round(x, 3)) for a, b, x in zip(scored.doc_id, scored.n_words, scored.score, strict=True)) == want


def test_key_packing():
    keys = np.unique(np.random.default_rng(2).integers(0, 1 << 40, 1000, dtype=np.uint64))
    assert (backoff.unpacked(backoff.packed(keys)) == keys).all()


# 8 classifier


def test_marginals_match_enumeration():
    rng = np.random.default_rng(4)
    field = quality.unlabelled_field()
    field.change = rng.standard_normal((2, 2))
    counts = np.array([1, 4, 3])
    good = rng.standard_normal(8)
    p, pairs, norm = field.marginals(good, counts)
    at, total = 0, np.zeros((2, 2))
    for c, z in zip(counts, norm, strict=True):
        weights, lit = [], np.zeros(c)
        for labels in np.ndindex(*[2] * c):
            w = np.exp(sum(good[at + i] * l for i, l in enumerate(labels)) + sum(field.change[a, b] for a, b in pairwise(labels)))
            weights.append(w)
            lit += w * np.array(labels)
            for a, b in pairwise(labels):
                total[a, b] += w / np.exp(z)
        assert np.log(sum(weights)) == pytest.approx(z)
        assert p[at : at + c] == pytest.approx(lit / sum(weights))
        at += c
    assert pairs == pytest.approx(total)


def test_held_out_accuracy(spark):
    got = run(spark, "op8_crf_quality", "/root/testdata/sf0.01")
    both = got.merge(pd.read_parquet("/root/testdata/sf0.01/labels.parquet"), on="doc_id")
    held = both[both.held_out]
    assert (held.predicted == held.quality).mean() > 0.95
    assert held[held.quality == 1].predicted.mean() > 0.98
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()


def test_classifier_on_awkward_documents(spark, folder):
    got = run(spark, "op8_crf_quality", folder("docs"))
    assert len(got) == len(rows_of()) and got.score.between(0, 1).all()


# 9 encoding


def test_encoding_equals_the_library(spark, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = run(spark, "op9_bpe_round_trip", folder("docs"))
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter()
    for r in rows_of():
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want[r[0], len(ids), digest(np.array(ids, dtype="<u4").tobytes()), digest(library.decode(ids, skip_special_tokens=False).encode())] += 1
    none = lambda x: None if pd.isna(x) else int(x)
    assert Counter((none(a), b, c, d) for a, b, c, d in got[["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]].itertuples(index=False)) == want


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="abcABC 0'sretvml\n\t　é😀", max_size=200)))
def test_encoding_of_any_text(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = _library(public_tokenizers, Tokenizer)
    own = bpe.codec(bpe.default_vocabulary())
    ids = np.frombuffer(own.encode(text), dtype="<u4")
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert own.decode(ids) == text


_KEPT: list = []


def _library(package, kind):
    if not _KEPT:
        _KEPT.append(kind.from_file(package.path("byte_bpe_50k.json")))
    return _KEPT[0]


# 10 extraction


def test_extraction(spark, folder):
    got = run(spark, "op10_html_main_text", folder("docs"))
    texts = Counter(zip([None if pd.isna(x) else int(x) for x in got.page_id], got.text, strict=True))
    article = "A title First paragraph with été and enough words to be content, really. Short."
    assert texts == Counter({(1, article): 2, (2, ""): 1, (3, ""): 1, (None, "unclosed x & y"): 1})
    assert (got.n_chars == got.text.str.len()).all()


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<body><div class='menu'><a href=x>a</a> <a href=y>b</a></div><div id=content><p>One long paragraph of real text, with words.</p><p>And another one that goes on for a while.</p></div><div class='sidebar'><p>Aside words here to skip.</p></div></body>", "One long paragraph of real text, with words. And another one that goes on for a while."),
        ("<article class='post has-sidebar'><h2>T</h2>text <i>in</i>line&nbsp;now<br>next line<ul><li>i1</li><li>i2</li></ul></article>", "T text inline now next line i1 i2"),
        ("<p>a<!-- no --></p><noscript>x</noscript><p>&lt;b&gt; &#233;</p>", "a <b> é"),
    ],
)
def test_pages(page, want):
    assert html.main_text(page) == want
