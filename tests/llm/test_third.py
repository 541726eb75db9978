"""Sharding, the prefix trie and spelling variants against brute force, SQL and edge cases."""

import itertools
import os
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import naive
from tests.llm.helpers import EDGES, corpus, frame
from tideframe.llm import prefix_trie, queries, secret_scan, sharding, spelling
from tideframe.llm.common import written

SF = "/root/testdata/sf0.001"
DOCS = corpus() + EDGES


@pytest.fixture(scope="module")
def docs(spark):
    return written(frame(spark, DOCS), "docs")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], frame(spark, EDGES[3:4]).schema)


# -- sharding


def check_shards(rows, docs, shards, most):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in docs)
    assert {r["law"] for r in rows} <= {"bytes"} and {r["grown_shard"] for r in rows} <= {None}
    for s in range(shards):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    load = Counter()
    for r in rows:
        load[r["shard"]] += r["size"]
    mean = sum(load.values()) / shards
    assert set(load) <= set(range(shards)) and max(load.values()) <= most * mean
    return load, mean


def test_shards_are_near_equal(spark):
    rng = random.Random(1)
    docs = [(i, "x" * int(rng.lognormvariate(5, 1)) + str(i), "en", "s") for i in range(3000)]
    load, mean = check_shards(sharding.shard(frame(spark, docs)).collect(), docs, 8, 1 + 2 * sharding.SLACK)
    assert len(load) == 8 and min(load.values()) >= (1 - 8 * 2 * sharding.SLACK) * mean


def test_a_third_of_rows_are_one_text(spark):
    """The group is larger than a shard, so it is split; texts with a few copies stay together."""
    docs = [(i, f"text {i}" * 20, "en", "s") for i in range(600)] + [(1000 + i, "the same " * 20, "en", "s") for i in range(300)] + [(2000 + i, f"text {i}" * 20, "en", "s") for i in range(20)]
    rows = sharding.shard(frame(spark, docs)).collect()
    check_shards(rows, docs, 8, 1.02)
    homes = {}
    for r in rows:
        homes.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert len(homes.pop(zlib.crc32(("the same " * 20).encode()))) > 1
    assert {len(x) for x in homes.values()} == {1}


def test_many_light_rows_go_by_levels_of_the_ring(spark):
    """One row at a time by the definition: first open shard clockwise, in the order of levels."""
    docs = [(i, f"{i:06d}", "en", "s") for i in range(20_000)]
    rows = sharding.assign(sharding.rows_of(frame(spark, docs))).collect()
    ring, capacity = sharding.Ring.of(8), 7 * len(docs) / 8 * (1 + sharding.SLACK)
    keys = np.array([r["key"] for r in rows], np.int64).view(np.uint64)
    level, arc, load = sharding.level_of(keys), ring.arc(keys), np.zeros(8)
    for _, group in itertools.groupby(np.argsort(level, kind="stable").tolist(), key=lambda i: level[i]):
        closed, group = load >= capacity, list(group)
        for i in group:
            want = next(s for s in ring.choices[arc[i]] if not closed[s])
            assert rows[i]["shard"] == want and rows[i]["home_shard"] == ring.choices[arc[i]][0]
            load[want] += rows[i]["size"]
    assert (load >= capacity).sum() > 2 and any(r["shard"] != r["home_shard"] for r in rows)


def test_one_more_shard_moves_few(spark):
    docs = frame(spark, [(i, f"{i:06d}", "en", "s") for i in range(20_000)])
    rows = sharding.rows_of(docs)
    before, after = ({r["row"]: r["shard"] for r in sharding.assign(rows, k).collect()} for k in (8, 9))
    moved = sum(before[k] != after[k] for k in before) / len(before)
    assert 0.05 < moved < 0.3


def test_shards_of_edges_and_nothing(spark, docs, empty):
    check_shards(sharding.shard(docs).collect(), DOCS, 8, 8)
    assert sharding.shard(empty).collect() == []
    one = sharding.shard(frame(spark, [(None, None, None, None)] * 50)).collect()
    assert len({r["shard"] for r in one}) > 1 and all(r["size"] == 1 for r in one)


# -- prefix trie


CONVERSATIONS = "conv_id long, turn long, role string, text string, depth int, x string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], CONVERSATIONS).repartition(5)


def some_conversations(seed=0, n=260):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if rng.random() < 0.1:
            continue
        common = rng.randrange(4)
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, ("user", "assistant")[t % 2], f"common {common} {t}" if t < rng.randint(0, 8) else f"own {rng.randrange(50)}"))
    return rows


def as_rows(got):
    key = lambda r: tuple(-1 if x is None else x for x in r)
    return sorted((tuple(r) for r in got), key=key)


@pytest.mark.parametrize("width", [3, 4096])
def test_trie(spark, monkeypatch, width):
    """With short stretches of paths, short pieces of end lists and few children for a broadcast too."""
    monkeypatch.setattr(prefix_trie, "WIDTH", width)
    if width == 3:
        monkeypatch.setattr(prefix_trie, "PIECE", 2)
        monkeypatch.setattr(prefix_trie, "HOT", 0.02)
    rows = some_conversations() + [(300 + i, t, "user", f"one {t}") for i in range(40) for t in range(3)]
    assert as_rows(prefix_trie.trie(conversations(spark, rows)).collect()) == as_rows(naive.trie(rows))


def test_trie_of_edges(spark):
    """Nulls, repeated turns, gaps, negative ids, a very long text, a long conversation, conversations rebuilt to nothing."""
    rows = [(None, 1, "user", "nobody's"), (7, None, None, None), (7, 1, "user", "a"), (7, 1, "user", "a"), (-5, 3, None, "b"), (-105, 0, "user", "b"), (200, 5, "user", "x" * 300_000), (201, 1, "user", "y")]
    rows += [(400, t, "user", f"turn {t}") for t in range(700)] + [(401 + i, t, "user", f"turn {t}") for i in range(5) for t in range(690 + i)]
    rows += [(1000 + 101 * i, 0, "user", "short") for i in range(30)]
    got = prefix_trie.trie(conversations(spark, rows)).collect()
    assert as_rows(got) == as_rows(naive.trie(rows))
    assert prefix_trie.trie(conversations(spark, rows).where("false")).collect() == []


def test_trie_root_has_the_turnless(spark):
    rows = [(c, 0, "user", "only") for c in range(101, 200)]
    root = next(r for r in prefix_trie.trie(conversations(spark, rows)).collect() if r["depth"] == 0)
    assert root["n_convs"] == 99 and root["parent_conv_id"] is None and root["ends_sha256"] != naive.trie([])


# -- spelling


def naive_variants(docs, least=7, least_n=2, factor=10):
    counts = Counter()
    for doc_id, text, *_ in docs:
        for run in "".join(c if c.isascii() and c.isalpha() or "À" <= c <= "ÿ" else " " for c in text or "").split():
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= least_n}
    near = {w: [v for v in words if one_edit(v, w)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= factor * n else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w] or "", root(w), words[w], len(near[w]), words[form[w]] if form[w] else -1) for w in words)


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def variants_of(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], -1 if r["form_n"] is None else r["form_n"]) for r in df.collect())


def spelt(rng, n):
    """Texts of a few words, of which some are misspelt, also at their ends and twice in a row."""
    base = ["".join(rng.choice("aabeinrstéß") for _ in range(rng.randint(7, 11))) for _ in range(25)]
    out = []
    for i in range(n):
        words = []
        for _ in range(60):
            w = rng.choice(base) if rng.random() < 0.8 else base[0]
            while rng.random() < 0.12:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("aeé") + w[k:], w[:k] + rng.choice("stß") + w[k + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        out.append((i, " ".join(words), "en", "s"))
    return out


@pytest.mark.parametrize("share", [0.0, 0.02, 1.0])
def test_variants(spark, share):
    """Whatever the dictionary: no gram grows, some do, all do."""
    chain = [(1000 + i, "transport " * 30 + "transpart " * 10 * (i < 8) + "xtranspart " * 2 * (i < 3), "en", "s") for i in range(60)]
    docs = spelt(random.Random(3), 120) + chain
    got = variants_of(spelling.variants(frame(spark, docs), share=share))
    assert got == naive_variants(docs)
    assert sum(bool(r[1]) for r in got) > 50 and any(r[1] and r[2] != r[1] for r in got)


def test_variants_of_edges(spark, docs, empty):
    assert variants_of(spelling.variants(docs)) == naive_variants(DOCS)
    assert spelling.variants(empty).collect() == []
    with pytest.raises(ValueError):
        spelling.variants(docs, least=6)


WORDS = st.text(alphabet="abé", min_size=7, max_size=12)


@settings(max_examples=400, deadline=None)
@given(word=WORDS, grow=st.frozensets(st.text(alphabet="abé", min_size=2, max_size=4), max_size=40), k=st.integers(0, 12), c=st.sampled_from("abéz"), kind=st.sampled_from(["replace", "insert"]))
def test_near_words_share_a_merged_list(word, grow, k, c, kind):
    """For any dictionary whose grams grow from grams that grow."""
    grow = frozenset(g for g in grow if all(g[:q] in grow for q in range(2, len(g))))
    k = min(k, len(word) - (kind == "replace"))
    other = word[:k] + c + word[k + (kind == "replace") :]
    longer, shorter = (word, other) if kind == "replace" else (other, word)
    assert spelling.merged_lists(longer, grow)[0][k] in sum(spelling.merged_lists(shorter, grow), [])
    # the bound: grams that the edit doesn't affect are grams of the other word too, and some always are
    n_grams = len(spelling.grams(word, grow))
    assert max(spelling.affected(word, grow)) < n_grams
    kept = [(p, e) for p, (e, seen) in enumerate(spelling.grams(longer, grow)) if seen <= k] + [(p, e) for p, (e, _) in enumerate(spelling.grams(longer, grow)) if p > k]
    shift = len(longer) - len(shorter)
    there = {(p, e) for p, (e, _) in enumerate(spelling.grams(shorter, grow))}
    assert all((p - shift * (p > k), e - shift * (p > k)) in there for p, e in kept)


# -- SQL


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, SF).select(*want.columns)
    say = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert say(got.collect()) == say(want.fetchall())


# -- secrets: whole values


WORDS_OF_CONTEXT = ["password", "passwd", "passphrase", "passcode", "pwd", "secret", "token", "apikey", "api_key", "api-key", "accesskey", "access_key", "privatekey", "private-key", "credentials", "credential", "auth", "bearer"]


def guessed(text):
    """Spans of guessed values by trying every position, character by character."""
    from tideframe.llm.secret_scan import GUESSES, guess_cost

    def at(i):
        for w in WORDS_OF_CONTEXT:
            if text[i : i + len(w)].lower() != w:
                continue
            j = i + len(w)
            ways = []
            for q in (1, 0):
                if q and text[j : j + 1] not in tuple("\"'`"):
                    continue
                k = j + q
                n = len(text[k:]) - len(text[k:].lstrip(" "))
                ways += [k + m + len(sep) for m in range(n, -1, -1) for sep in ("=>", ":=", ":", "=", " is ") if text.startswith(sep, k + m) or (sep == " is " and text[k + m : k + m + 4].lower() == sep)]
            for k in ways:
                k += len(text[k:]) - len(text[k:].lstrip(" "))
                if (got := value(k)) is not None:
                    return got
            if w == "bearer" and text[j : j + 1] == " ":
                k = j + len(text[j:]) - len(text[j:].lstrip(" "))
                if (got := value(k)) is not None:
                    return got
        return None

    def value(k):
        q, j = text[k : k + 1], k + 1
        if q in tuple("\"'`"):
            while j < len(text) and text[j] not in "\r\n" + q:
                j += 2 if text[j] == "\\" and j + 1 < len(text) and text[j + 1] != "\n" else 1
            if k + 1 < j < len(text) and text[j] == q:
                return k + 1, j, j + 1
        j = k
        while j < len(text) and not text[j].isspace():
            j += 1
        if j == k:
            return None
        whole = text[k:j]
        kept = whole.rstrip(".,;:!?)]}\"'`")
        kept = kept.lstrip("\"'`")
        a = text.index(kept, k)
        return a, a + len(kept), j

    out, i = [], 0
    while i < len(text):
        got = at(i)
        if got is None:
            i += 1
            continue
        a, b, i = got
        if b - a >= 6 and guess_cost(text[a:b]) >= GUESSES:
            out.append((a, b))
    return out


VALUE = st.text(alphabet="abXY79#;,'\"éß日!", min_size=1, max_size=16)
PIECE = st.one_of(
    st.sampled_from(["the", "author", "said", "\n", "is", "my auth", "12:30", "key"]),
    st.builds(lambda w, s, q, v: w + s + q + v + q, st.sampled_from([*WORDS_OF_CONTEXT, "PassWord", "Bearer"]), st.sampled_from([": ", "=", " => ", " is ", ":=", '": ', " ", "  =  "]), st.sampled_from(["", "", '"', "'", "`"]), VALUE),
)


@settings(max_examples=300, deadline=None)
@given(pieces=st.lists(PIECE, max_size=6))
def test_guessed_spans_of_whole_texts(pieces):
    text = " ".join(pieces)
    assert [(a, b) for a, k, b in secret_scan.spans(text) if k == "guess"] == guessed(text)


@pytest.mark.parametrize("text,secret", [
    ('pwd: "Tz8#kQ;9vLm2!xW" ok', "Tz8#kQ;9vLm2!xW"), ("passphrase='kQ9,vLm2!xWz7Rt'", "kQ9,vLm2!xWz7Rt"), ("pwd: Ünïcødé#8xQ!z9Lm2.", "Ünïcødé#8xQ!z9Lm2"),
    ("token => x9K,2;v8Qz!p, and", "x9K,2;v8Qz!p"), ('{"password": "a\\"b8Q#zz!K2", "n": 1}', 'a\\"b8Q#zz!K2'), ('secret: "open#8xQ!z9Lm2 end', "open#8xQ!z9Lm2"),
])
def test_no_tail_of_a_secret_stays(spark, text, secret):
    clean = secret_scan.redact(frame(spark, [(1, text, "en", "s")])).first()["text"]
    assert text.index(secret) >= 0 and not any(secret[i : i + 4] in clean for i in range(len(secret) - 3))


# -- near-copies at the limit


@pytest.mark.parametrize("texts,passage,share,least", [(250, 0, 0.1, 0.98), (250, 0, 0.2, 0.9), (250, 50, 0.15, 0.9), (250, 70, 0.2, 0.9), (1000, 70, 0.15, 0.9), (1000, 70, 0.2, 0.9)])
def test_recall_of_near_copies(spark, texts, passage, share, least):
    """Of the copies that align, nine in ten are joined, in small buckets and where all texts share a passage, at the limit itself too; others never are."""
    from tideframe.llm import near_copies
    from tideframe.llm.quality_rules import word_hashes

    rng = random.Random(texts + passage)
    words = [f"w{i}" for i in range(3000)]
    common = [rng.choice(words) for _ in range(passage)]
    base = [common + [rng.choice(words) for _ in range(100 - passage)] for _ in range(texts)]
    copies = [[rng.choice(words) + "x" if rng.random() < share else w for w in b] for b in base[:150]]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)] + [(10**6 + i, " ".join(c)) for i, c in enumerate(copies)]
    got = {r["doc_id"]: r["class_id"] for r in near_copies.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    coded = lambda ws: word_hashes([w.encode() for w in ws]).astype(np.uint32)
    aligned = [i for i, c in enumerate(copies) if near_copies.aligned(coded(base[i]), coded(c))]
    assert len(aligned) > 50 and sum(got[i] == got[10**6 + i] for i in aligned) >= least * len(aligned)
    assert all(got[i] == i for i in range(texts))


def test_links_that_sketches_miss(spark):
    """All pairs that align are joined, whatever their length and however they lie: short texts, pairs at the limit itself, and at it beside a passage that all share."""
    from tideframe.llm import near_copies
    from tideframe.llm.quality_rules import word_hashes

    rng = random.Random(77)
    words = [f"w{i}" for i in range(400)]
    common = [rng.choice(words) for _ in range(60)]
    rows = []
    for k in range(220):
        n = (rng.randint(5, 16), rng.randint(17, 60), 60)[k % 3]
        base = (common if k % 3 == 2 else []) + [rng.choice(words) for _ in range(n)]
        most, copy = near_copies.most_edits(len(base)), list(base)
        for i in rng.sample(range(len(copy)), rng.choice([most, most, max(most - 1, 0)])):
            copy[i] = f"new{rng.randint(0, 99)}"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy if k % 4 else copy[1:] + ["last"]))]
    coded = [word_hashes([w.encode() for w in t.split()]).astype(np.uint32) for _, t in rows]
    top = list(range(len(rows)))

    def of(k):
        return k if top[k] == k else of(top[k])

    for i in range(len(rows)):
        for j in range(i):
            if near_copies.aligned(coded[i], coded[j]):
                top[max(of(i), of(j))] = min(of(i), of(j))
    got = {r["doc_id"]: r["class_id"] for r in near_copies.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert [got[i] for i in range(len(rows))] == [of(i) for i in range(len(rows))] and len(set(got.values())) < 300


@pytest.mark.parametrize("least", [0.8, 0.9])
def test_prefixes_meet(least):
    """Of two texts that align, the prefixes meet in as many words as a link asks for, at places that the edits allow."""
    from tideframe.llm import near_copies

    rng = np.random.default_rng(5)
    counts = rng.integers(1, 50, 1024).astype(np.uint32)
    seen = 0
    for _ in range(400):
        n = int(rng.integers(1, 250))
        a = rng.integers(0, rng.choice([20, 300, 5000]), n).astype(np.uint32)
        b = list(a)
        for _ in range(int(rng.integers(0, near_copies.most_edits(n, least) + 1))):
            i = int(rng.integers(0, len(b) + 1))
            b[i : i + int(rng.integers(0, 2))] = [int(rng.integers(0, 5000))] * int(rng.integers(0, 2))
        b = np.array(b, np.uint32)
        if not len(b) or not near_copies.aligned(a, b, least):
            continue
        seen += 1
        longer = max(n, len(b))
        most = near_copies.most_edits(longer, least)
        needed = min(longer - most, longer // near_copies.SPARE + 1)
        (ha, xa), (hb, xb) = (near_copies.prefix(w, counts, least) for w in (a, b))
        in_b, met = {h: k for k, h in enumerate(hb.tolist())}, 0
        for i, h in enumerate(ha.tolist()):
            j = in_b.get(h)
            if j is not None and i < n - longer + most + needed and j < len(b) - longer + most + needed:
                x, y = int(xa[i]), int(xb[j])
                met += x < 0 or y < 0 or abs(x - y) + abs((n - x) - (len(b) - y)) <= most
        assert met >= needed
    assert seen > 200


def test_prefixes_of_grams_meet():
    """Where frequent words are parts of grams, texts that align meet in as many grams as both ask for, at places that the edits allow; inserted words part grams too."""
    from tideframe.llm import near_copies

    rng = np.random.default_rng(6)
    counts = rng.integers(1, 50, 1024).astype(np.uint32)
    often, total, seen, long = (np.zeros(0, np.uint64), np.zeros(0)), float(counts.sum()), 0, 0
    for round_ in range(600):
        n = int(rng.integers(1, 250))
        a = rng.integers(0, rng.choice([3, 20, 300, 5000]), n).astype(np.uint32)
        b = list(a)
        for _ in range(int(rng.integers(0, near_copies.most_edits(n) * 5 // 4 + 1))):
            i = int(rng.integers(0, len(b) + 1))
            b[i : i + (0 if round_ % 2 else int(rng.integers(0, 2)))] = [int(rng.integers(0, 5000))] * (1 if round_ % 2 else int(rng.integers(0, 2)))
        b = np.array(b, np.uint32)
        if not len(b) or (n == len(b) and (a == b).all()) or not near_copies.aligned(a, b):
            continue
        seen += 1
        most, met = near_copies.most_edits(max(n, len(b))), 0
        rare = (0.5, 10, 40)[round_ % 3]
        (ha, xa, ka, pa), (hb, xb, kb, pb) = (near_copies.prefix_of(w, counts, 0.8, rare, total, often, near_copies.longest_gram()) for w in (a, b))
        early = most + min(ka, kb)
        at = {h: y for h, y, p in zip(hb.tolist(), xb.tolist(), pb.tolist(), strict=True) if p < early}
        for h, x, p in zip(ha.tolist(), xa.tolist(), pa.tolist(), strict=True):
            if h in at and p < early:
                y = at[h]
                met += x < 0 or y < 0 or abs(x - y) + abs((n - x) - (len(b) - y)) <= most
        assert met >= min(ka, kb) >= 1
        long += min(ka, kb) > 1
    assert seen > 300 and long > 100


def test_buckets_of_the_exact_join_do_not_grow_with_the_table(spark):
    """Four times the texts of the same words give about four times the meetings, not sixteen times; copies are joined in both tables."""
    from pyspark.sql import functions as F

    from tideframe.llm import near_copies

    rng = random.Random(9)
    words = [f"w{i}" for i in range(2000)]
    met = []
    for n in (750, 3000):
        rows = [(i, " ".join(rng.choice(words) for _ in range(100))) for i in range(n)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        nodes = near_copies.sketches(docs).select("node", "key")
        members = near_copies._prefixes(written(near_copies._node_words(docs, nodes).withColumn("root", F.lit(None).cast("binary")), "words"), near_copies.SIMILARITY)
        met.append(near_copies._met(members, members, ["bucket"], near_copies.SIMILARITY).count())
    assert met[1] <= 8 * max(met[0], 1000), met


def brute_links(rows):
    """Least place of each row's class, by aligning all pairs."""
    from tideframe.llm import near_copies
    from tideframe.llm.quality_rules import word_hashes

    coded, top = [word_hashes([w.encode() for w in t.split()]).astype(np.uint32) for _, t in rows], list(range(len(rows)))

    def of(k):
        return k if top[k] == k else of(top[k])

    for i in range(len(rows)):
        for j in range(i):
            if near_copies.aligned(coded[i], coded[j]):
                top[max(of(i), of(j))] = min(of(i), of(j))
    return [of(i) for i in range(len(rows))]


def repeating(rng, n):
    """Texts of lines that they repeat and share with many others, and as many copies with as many edits as a link allows, or one more."""
    from tideframe.llm import near_copies

    words = [f"w{i}" for i in range(300)]
    line = lambda k: [rng.choice(words) for _ in range(k)]
    shared, rows = [line(12) for _ in range(3)], []
    for k in range(n):
        base = line(rng.randint(3, 12)) * rng.randint(1, 6) + rng.choice(shared) * rng.randint(0, 3) + line(rng.randint(0, 20))
        most, copy = near_copies.most_edits(len(base)), list(base)
        for i in rng.sample(range(len(copy)), min(len(copy), most + k % 2)):
            copy[i : i + 1] = [] if rng.random() < 0.2 else [rng.choice(words) if rng.random() < 0.5 else f"new{rng.randint(0, 99)}"]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy) or "none")]
    return rows


@pytest.mark.parametrize("changed", [{"SAMPLE": 0}, {"SAMPLE": 3}, {"SAMPLE": 10**9}, {"RARE": 0.001, "BLOCK": 8, "RANGE": 500, "NEAREST": 1}])
def test_links_of_texts_that_repeat_lines(spark, monkeypatch, changed):
    """All links, whatever texts are sampled for the order of grams, none or all of them; and where all grams are frequent ones, compared in small blocks."""
    from tideframe.llm import near_copies

    for name, value in changed.items():
        monkeypatch.setattr(near_copies, name, value, raising=False)
    rows = repeating(random.Random(12), 130)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    known = written(near_copies.sketches(docs), "sketches")
    for levels in (near_copies.LEVELS, ()):
        roots = {bytes(r["node"]): bytes(r["root"]) for r in near_copies.groups(docs, known, levels=levels).collect()}
        node = [near_copies.node_of(near_copies.words_of(t)) for _, t in rows]
        least: dict = {}
        got = [least.setdefault(roots.get(x, x), k) for k, x in enumerate(node)]
        assert got == brute_links(rows) and len(set(got)) < 220


def test_texts_that_repeat_lines_do_not_meet_by_a_shared_one(spark):
    """A text of one line over and over has as many places of its own as any other, so what all share isn't in its prefix."""
    from pyspark.sql import functions as F

    from tideframe.llm import near_copies

    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    shared = [rng.choice(words) for _ in range(12)]
    rows = [(i, " ".join([rng.choice(words) for _ in range(12)] * 12 + shared)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    nodes = near_copies.sketches(docs).select("node", "key")
    members = near_copies._prefixes(written(near_copies._node_words(docs, nodes).withColumn("root", F.lit(None).cast("binary")), "words"), near_copies.SIMILARITY)
    assert near_copies._all_met(members, near_copies.SIMILARITY).count() < 300
