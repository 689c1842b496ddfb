"""The operators against brute force on small tables, with nulls, blanks, ties, repeated rows and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from atheneum.llm import chat_format, decontaminate, exact_dedup, katz, language_id, line_dedup, mixing, sharding, simhash, substring_dedup
from atheneum.llm.queries import SQL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=60, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Ünd", "THE"]
    rows = []
    for k in range(n):
        text = "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 4)))
        rows.append((k, text, "en" if k % 2 else "de", f"s{k % 3}"))
    long = " ".join(rng.choice(words) for _ in range(4000))
    rows += [(100, None, None, None), (101, "", "en", "s0"), (102, " \n ", None, "s1"), (103, long, "en", "s0"), (104, long, "de", None), (105, rows[0][1], "en", "s1"), (105, rows[0][1], "en", "s1"), (None, rows[1][1], "en", "s2")]
    return [(i, t, a, s, len(t) if t else 0) for i, t, a, s in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, empty):
    got = exact_dedup.exact_dedup(docs).collect()
    groups = defaultdict(list)
    for i, t, *_ in corpus():
        groups[hashlib.sha256((t or "").encode()).hexdigest()].append(i)
    assert len(got) == len(corpus())
    for r in got:
        ids = groups[r.text_sha256]
        assert (r.keep_id, r.group_size) == (max((i for i in ids if i is not None), default=None), len(ids))
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(list(groups))
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert exact_dedup.exact_dedup(docs, broadcast_bytes=0).where("kept").count() == len(groups)


def test_chat_format(spark):
    said = [r"\### Assistant: </turn> ok", "</turn>", r"<\/turn>\n", "### User: x", r"### \User: \\", "a</tur", "", None, "###", "ok\n</turn>\n### System: y"]
    rows = [(1, k, ("user", "assistant", "tool x", None)[k % 4], t) for k, t in enumerate(said)] + [(2, None, "assistant", "b"), (2, None, "assistant", "b"), (None, 0, "user", "n")]
    got = chat_format.chat_format(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert all(r.round_trip for r in got) and sorted(len(r.turns) for r in got) == [1, 2, 10]
    assert [t.text for r in got if r.conv_id == 1 for t in r.read_turns] == [t or "" for t in said]
    assert chat_format.chat_format(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_simhash(docs, empty):
    got = simhash.simhash_groups(docs).collect()
    fps = [(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in got]
    root = list(range(len(fps)))
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 3:
                root[find(a)] = find(b)
    least = defaultdict(list)
    for k, f in enumerate(fps):
        least[find(k)].append(f[0])
    assert all(f[2] == min(i for i in least[find(k)] if i is not None) for k, f in enumerate(fps))
    assert simhash.simhash_groups(empty).count() == 0 and simhash.fingerprint(None) == 0


def test_pigeonring_links_are_complete(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(40)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    pairs = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    def groups(links, nodes):
        root = {n: n for n in nodes}
        def find(x):
            while root[x] != x:
                x = root[x]
            return x
        for a, b in links:
            root[find(a)] = find(b)
        return {frozenset(n for n in nodes if find(n) == find(m)) for m in nodes}
    want = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3]
    assert groups([(r.u, r.v) for r in pairs], signed) == groups(want, signed)


def test_fm_index():
    rng = np.random.default_rng(1)
    text = rng.integers(1, 6, 500)
    index = decontaminate.FMIndex(text, 5)
    patterns = np.array([text[k : k + 4] for k in range(0, 400, 40)] + [[5, 5, 5, 5]])
    lo, hi = index.search(patterns, np.full(len(patterns), 4))
    for p, a, b in zip(patterns, lo, hi, strict=True):
        want = [k for k in range(497) if (text[k : k + 4] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_decontaminate(spark, docs, empty):
    bench = spark.createDataFrame([("a", corpus()[2][1]), ("b", "w1 w2"), ("c", "--"), ("d", None), (None, "w3 w4"), ("a", corpus()[3][1])], "item_id string, text string")
    got = decontaminate.find_windows(docs, bench, ["doc_id", "text"]).collect()
    items = [(i, decontaminate.words_of((t or "").encode())) for i, t in (tuple(r) for r in bench.collect())]
    for r in got:
        ws = decontaminate.words_of((r.text or "").encode())
        hit, names = set(), set()
        for i, w in items:
            n = min(13, len(w))
            for k in range(len(w) - n + 1 if n else 0):
                for at in range(len(ws) - n + 1):
                    if ws[at : at + n] == w[k : k + n]:
                        hit |= set(range(at, at + n))
                        names |= {i} - {None}
        assert r.n_words == len(ws) and {x for s in r.spans for x in range(s.start, s.end)} == hit and r["items"] == sorted(names)
    assert decontaminate.find_windows(empty, bench, ["doc_id"]).count() == 0
    assert decontaminate.find_windows(docs, bench.limit(0), ["doc_id"]).where("size(spans) > 0").count() == 0


def test_decontaminate_in_passes(spark, docs, monkeypatch):
    """A benchmark that takes several passes gives what one pass gives."""
    bench = spark.createDataFrame([(f"i{k}", " ".join((corpus()[k][1] or "").split()[:20])) for k in range(12)] + [("none", None)], "item_id string, text string")
    shown = lambda df: sorted(str(tuple(r)) for r in df.collect())
    want, bare = (shown(decontaminate.find_windows(docs, bench, keep)) for keep in (["doc_id", "text"], ["doc_id"]))
    monkeypatch.setattr(decontaminate, "PASS_BYTES", 200)
    assert len(list(decontaminate._passes(bench))) > 3 and shown(decontaminate.find_windows(docs, bench, ["doc_id", "text"])) == want
    assert shown(decontaminate.find_windows(docs, bench, ["doc_id"])) == bare


def test_language_id(docs, empty):
    assert language_id.train(empty) is None
    got = {r.doc_id: r for r in language_id.identify(docs, language_id.train(docs)).collect()}
    assert got[100].lang_pred == got[101].lang_pred == got[102].lang_pred == "und" and 0 < got[103].score <= 1
    assert language_id.identify(empty, None).count() == 0


def test_language_id_held_out(spark):
    from atheneum.llm.queries import QUERIES

    got = QUERIES["op4_language_id"](spark, "/root/testdata/sf0.01").where("held_out")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    assert got.join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_line_dedup(docs, empty):
    got = line_dedup.line_dedup(docs).collect()
    assert len(got) == len(corpus()) and line_dedup.line_dedup(empty).count() == 0
    by = {r.doc_id: r for r in got}
    assert by[105].dropped_lines == list(range(by[105].n_lines)) and by[100].text is None and by[102].dropped_lines == []
    source = {i: t for i, t, *_ in corpus()}
    for i, r in by.items():
        if source[i] is not None:
            assert r.text == "\n".join(x for k, x in enumerate(source[i].split("\n")) if k not in r.dropped_lines)


def test_substring_dedup(spark, docs, empty):
    rng = random.Random(9)
    word = lambda: f"x{rng.randrange(5000)}"
    shared = [word() for _ in range(60)]
    fuzzy = [w if k % 21 != 20 else "changed" for k, w in enumerate(shared)]
    rows = [(1, [word() for _ in range(90)] + shared + [word() for _ in range(70)]), (2, [word() for _ in range(40)] + fuzzy), (3, [word() for _ in range(300)]), (4, shared + [word() for _ in range(20)])]
    got = {r.doc_id: r for r in substring_dedup.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()}
    assert got[3].n_dup_words == 0 and all(got[i].n_dup_words >= 58 for i in (1, 2, 4))
    assert got[1].spans[0].start <= 91 and got[1].spans[0].end >= 149
    assert len(substring_dedup.repeated_passages(docs).collect()) == len(corpus()) and substring_dedup.repeated_passages(empty).count() == 0


def test_mixing(docs, empty):
    got = mixing.mix(docs, block_docs=8).collect()
    tokens, used, weight = Counter(), Counter(), {}
    for r in got:
        tokens[r.source] += r.n_tokens
        used[r.source] += r.n_tokens * r.copies
        weight[r.source] = r.weight
    assert math.isclose(sum(weight.values()), 1) and all(r.copies >= 1 for r in got)
    budget = max(tokens[s] / weight[s] for s in tokens)
    largest = max(r.n_tokens for r in got)
    for s in tokens:
        quota = weight[s] * budget
        assert quota - largest <= used[s] <= quota + 1e-6 and quota <= 2 * tokens[s] * (1 + 1e-6)
    assert mixing.mix(empty).count() == 0
    half = mixing.mix(docs, budget=1000.0, max_repeats=1e9, target_entropy=0.0).agg(F.sum(F.col("copies") * F.col("n_tokens"))).first()[0]
    assert half <= 1000


def test_sharding(docs, empty):
    got = sharding.shard(docs, arrivals=3, target_bytes=4000).collect()
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert Counter(tuple(r[c] for c in columns) for r in got) == Counter(corpus())
    assert all(n == {r.shard_rows for r in got if r.shard == s}.pop() for s, n in Counter(r.shard for r in got).items())
    assert sharding.shard(empty).count() == 0


def test_a_version_is_committed_once(spark, tmp_path, docs):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store")
    store.append(docs)
    with pytest.raises(Exception):  # noqa: B017
        store.commit(store.manifest(), 1)
    assert store.version() == 1


def test_katz(docs, empty):
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2
    rows = [(i, t) for i, t, *_ in corpus()]
    got = katz.katz_scores(docs, held, part_tokens=500).collect()
    is_held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter()
    for i, t in rows:
        if not is_held(i):
            counts.update([*(t or "").encode().lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    text = dict(rows)
    for r in got:
        ws = [*(text[r.doc_id] or "").encode().lower().split(), None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert r.score < 0
    assert katz.katz_scores(empty, held).count() == 0


def test_katz_scores_are_those_of_a_plain_model(docs):
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2
    words = {i: [*(t or "").lower().split(), "</s>"] for i, t, *_ in corpus()}
    one, two, context = Counter(), Counter(), Counter()
    for i, _, *_ in corpus():
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            pairs = list(zip(["<s>", *words[i]], words[i], strict=False))
            one.update(words[i])
            two.update(pairs)
            context.update(h for h, _ in pairs)
    of_counts = lambda c: [sum(n == r for n in c.values()) for r in range(1, katz.K + 2)]
    d1, d2, total = good_turing(of_counts(one)), good_turing(of_counts(two)), sum(one.values())
    low = lambda n, d: n * (d[n - 1] if n <= katz.K else 1)
    norm = total if min(one.values()) <= katz.K else total + 1
    p1 = {w: low(n, d1) / norm for w, n in one.items()}
    unseen = (1 - sum(p1.values())) / max(1, of_counts(one)[0])
    after = defaultdict(dict)
    for (h, w), n in two.items():
        after[h][w] = n

    def p2(h, w):
        if not context[h]:
            return p1.get(w, unseen)
        c, full = context[h], min(after[h].values()) > katz.K
        if w in after[h]:
            return after[h][w] / (c + 1) if full else low(after[h][w], d2) / c
        left = 1 / (c + 1) if full else 1 - sum(low(n, d2) for n in after[h].values()) / c
        return left / (1 - sum(p1[x] for x in after[h])) * p1.get(w, unseen)

    for h in context:
        assert math.isclose(sum(p2(h, w) for w in p1) + p2(h, "never seen") * max(1, of_counts(one)[0]), 1, rel_tol=1e-9)
    for parts, frequent in ((500, 10**6), (10**6, 10**6), (10**6, 20), (500, 0)):
        got = katz.katz_scores(docs, held, part_tokens=parts, frequent=frequent).collect()
        assert len(got) == len(corpus())
        for r in got:
            ws = words[r.doc_id]
            assert math.isclose(r.score, sum(math.log10(p2(h, w)) for h, w in zip(["<s>", *ws], ws, strict=False)), rel_tol=1e-9)


def good_turing(n, k=5):
    """Discounts from counts of counts by a fit of log n over log r, as a plain loop."""
    points = [(math.log(r), math.log(x)) for r, x in enumerate(n, 1) if x]
    slope = -1.2
    if len(points) > 1:
        mx, my = (sum(p[i] for p in points) / len(points) for i in (0, 1))
        slope = min(slope, sum((x - mx) * (y - my) for x, y in points) / sum((x - mx) ** 2 for x, _ in points))
    smooth = lambda r: math.exp(slope * math.log(r))
    cut = (k + 1) * smooth(k + 1) / smooth(1)
    return [((r + 1) * smooth(r + 1) / (r * smooth(r)) - cut) / (1 - cut) for r in range(1, k + 1)]


@pytest.mark.parametrize("counts", [[207344, 59772, 25017, 14274, 13493, 7080], [5, 0, 0, 0, 0, 0], [0] * 6, [0, 3, 0, 0, 9, 0], [1, 1, 1, 1, 1, 1], [10**9, 10**8, 10**7, 1, 1, 0]])
def test_discounts_are_valid(counts):
    d = katz.discounts(counts)
    assert (d > 0).all() and (d < 1).all() and np.allclose(d, good_turing(counts)) and (np.diff(d) > 0).all()


def test_katz_without_training_rows(docs):
    got = katz.katz_scores(docs, F.lit(True)).collect()
    assert len(got) == len(corpus()) and {(r.train_tokens, r.n_known, r.base_score, r.score) for r in got} == {(0, 0, 0.0, 0.0)}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    from atheneum.llm.queries import QUERIES

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    mine = QUERIES[name](spark, "/root/testdata/sf0.001")
    columns = ", ".join(f'"{c}"' for c in sorted(mine.columns))  # as rows: pandas turns whole numbers with nulls into floats
    theirs = con.execute(f"SELECT {columns} FROM ({SQL[name].strip()})").fetchall()
    assert sorted(mine.columns) == sorted(c[0] for c in con.execute(SQL[name]).description)
    assert sorted(str(tuple(r)) for r in mine.select(sorted(mine.columns)).collect()) == sorted(map(str, theirs))


def test_pipeline(spark):
    import corpus_pipeline

    got = Counter(r.doc_id for r in corpus_pipeline.run(spark, "/root/testdata/sf0.001").select("doc_id").collect())
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)]
    bad = {r.doc_id for r in decontaminate.verdict(decontaminate.find_windows(docs, spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet"), ["doc_id"])).where("contaminated").collect()}
    want = {r[0] for r in brute_near_dedup(rows)}
    assert len(want) < len(rows) and set(got) == want - bad and max(got.values()) <= 3


def test_passages_behind_a_shared_phrase(spark):
    rng = random.Random(11)
    words = lambda n: [f"x{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for k in range(30):  # a shared phrase of 12 to 30 words, unequal words, a shared passage of 100
        phrase, passage, gap = words(12 + k % 19), words(100), 13 + k
        rows += [(2 * k, words(40) + phrase + words(gap) + passage + words(30)), (2 * k + 1, words(20) + phrase + words(gap) + passage + words(50))]
    got = {r.doc_id: r.spans for r in substring_dedup.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()}
    for i, w in rows:
        start = len(w) - (50 if i % 2 else 30) - 100
        assert [(s.start, s.end) for s in got[i]] == [(start, start + 100)]


def test_passages_whose_parts_lead_elsewhere(spark):
    """Words 1-45 of a passage of 80 are in one text and 36-80 in another; the two texts that share the whole are linked."""
    rng, found = np.random.default_rng(8), 0

    def noise(n):
        return [f"n{x}" for x in rng.integers(0, 10**9, n)]

    rows = []
    for g in range(40):
        passage = [f"g{g}w{k}" for k in range(80)]
        rows += [noise(40) + passage[:45] + noise(40), noise(40) + passage[35:] + noise(40), noise(40) + passage + noise(40), noise(30) + passage + noise(50)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r for r in substring_dedup.repeated_passages(docs).collect()}
    for g in range(40):
        found += all(got[4 * g + k].n_dup_words >= 75 for k in (2, 3))
        assert got[4 * g + 2].n_dup_words <= 85 and got[4 * g].n_dup_words == got[4 * g + 1].n_dup_words == 0
    assert found >= 36


def test_frequent_keys_are_led_within_a_batch():
    """Of each frequent key, every row but those of the least class is linked to the least class's first place."""
    rng = np.random.default_rng(2)
    seed, of, pos = rng.integers(0, 9, 400).astype(np.uint64) ** 3, rng.integers(-20, 20, 400), rng.permutation(400)
    led, lead, other = substring_dedup._led(seed, of, pos, often=44)
    seen = set()
    for s in np.unique(seed):
        rows = sorted((int(of[k]), int(pos[k]), int(k)) for k in np.flatnonzero(seed == s))
        seen.add(len(rows) >= 44)
        for c, _, k in rows:
            assert led[k] == (len(rows) >= 44 and c != rows[0][0])
            assert not led[k] or (lead[k], other[k]) == rows[0][:2]
    assert seen == {True, False}


def test_passages_of_frequent_keys_are_found_alike(spark):
    """A passage that all texts share is found at the same words whether its keys are led within a batch or not."""
    rng = np.random.default_rng(5)
    common = [f"c{k}" for k in range(60)]
    rows = [[f"n{x}" for x in rng.integers(0, 10**9, 30 + i % 7)] + common + [f"m{x}" for x in rng.integers(0, 10**9, 20)] for i in range(90)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string").coalesce(2)
    for r in substring_dedup.repeated_passages(docs).collect():
        start = 30 + r.doc_id % 7
        assert [tuple(s) for s in r.spans] == [(start, start + 60)] and r.n_dup_words == 60


def test_equal_stretch_within_a_poor_alignment():
    same, poor = [(0, 0, 100)], [(100 + 12 * k, 100 + 12 * k, 4) for k in range(1, 30)]
    (found,) = substring_dedup.alike(same + poor)
    assert found[0] == found[2] == 0 and found[1] >= 100 and found[4] >= substring_dedup.MIN_IDENTITY * found[1]
    assert not list(substring_dedup.alike(poor))


def shingle_set(line, k=line_dedup.SHINGLE):
    return {line[i : i + k] for i in range(max(1, len(line) - k + 1))}


def line_components(lines, similarity=line_dedup.SIMILARITY):
    """Components of different lines by brute force over character shingles."""
    lines = sorted(set(lines))
    sets, root = [shingle_set(x) for x in lines], list(range(len(lines)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(lines)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared >= similarity * (len(sets[i]) + len(sets[j]) - shared):
                root[find(i)] = find(j)
    groups = defaultdict(set)
    for i, x in enumerate(lines):
        groups[find(i)].add(x)
    return {frozenset(g) for g in groups.values()}


def kept_lines(spark, lines, docs=7):
    """The groups that line_dedup makes of different lines, dealt over documents, and the texts it leaves."""
    rows = [(k, "\n".join(lines[k::docs])) for k in range(docs)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    source = line_dedup._lines(frame.select(F.col("doc_id").alias("_id"), F.xxhash64("doc_id", "text").alias("_row"), F.col("text").alias("_text"))).cache()
    name = {line_dedup._key(x.strip().lower()) & (1 << 64) - 1: x.strip().lower() for x in lines}
    groups = defaultdict(set)
    for r in line_dedup.line_groups(source, frame.select("doc_id", F.lit(0).alias("_row"), "text")).collect():
        groups[r.label].add(name[r._key & (1 << 64) - 1])
    return {frozenset(g) for g in groups.values()}, {r.doc_id: r.dropped_lines for r in line_dedup.line_dedup(frame).collect()}


def test_lines_of_a_template_family_are_linked_as_by_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: f"{rng.randrange(10**6):06d}"
    template = [word() for _ in range(30)]
    lines = []
    for _ in range(150):
        base = [word() if rng.random() < 0.13 else w for w in template]
        copy = list(base)
        copy[rng.randrange(30)] = word()
        lines += [" ".join(base), " ".join(copy)]
    want = {g for g in line_components(lines) if len(g) > 1}
    assert len(want) > 5 and max(map(len, want)) > 10
    for block in (line_dedup.BLOCK, 40):
        monkeypatch.setattr(line_dedup, "BLOCK", block)
        got, dropped = kept_lines(spark, lines)
        assert got == want
    assert sum(map(len, dropped.values())) == sum(len(g) - 1 for g in want)


def test_recall_and_precision_of_lines_on_real_documents(spark, monkeypatch):
    lines = {x.strip().lower() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() for x in (r.text or "").split("\n") if x.strip()}
    lines = sorted(lines)[::2]
    want = {g for g in line_components(lines) if len(g) > 1}
    for keys in (line_dedup.BROADCAST_KEYS, 0):
        monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", keys)
        got, _ = kept_lines(spark, lines)
        pairs = lambda groups: {(a, b) for g in groups for a in g for b in g if a < b}
        assert len(pairs(got) & pairs(want)) >= 0.98 * len(pairs(want)) and pairs(got) <= pairs(want)


def test_shingles_cover_every_character():
    lines = ["abc", "abcdefgh", "Ünïcödé wörds häve ströng tëxts", "x" * 300, "日本語" * 50]
    h, starts = line_dedup.shingle_hashes(lines)
    ends = [*starts[1:].tolist(), len(h)]
    seen = {}
    for x, a, b in zip(lines, starts.tolist(), ends, strict=True):
        k = line_dedup.SHINGLE
        of = [x[i : i + k] for i in range(max(1, len(x) - k + 1))]
        assert len(of) == b - a
        for s, v in zip(of, h[a:b].tolist(), strict=True):
            assert seen.setdefault(s, v) == v
    assert len(set(seen.values())) == len(seen)


def test_lines_that_differ_behind_the_first_characters_of_a_word_stay(spark):
    han = "".join(chr(0x4E00 + k) for k in range(60))
    lines = ["https://www.a.org/x", "https://www.b.com/y", "https://www.example.com/a-report-on-trains", "https://www.openstreetmap.org/way/123", "https://www.wikipedia.org/wiki/Zebra"]
    lines += [han[:12] + han[20:40], han[:12] + han[40:60], "a short line", "internationalization-of-texts", "internationalization-by-others", "abc", "abd"]
    long = "".join(chr(0x5000 + k % 7000) for k in range(60000))
    alike = [long, long[:399] + "x" + long[400:], "  ABC\t"]
    frame = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(alike)), (2, None), (None, "abd")], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.dropped_lines) for r in line_dedup.line_dedup(frame).collect()))
    assert got == [(0, []), (1, [11]), (2, []), (2, [1, 2])]


CLASHES = ["n_tokens", "weight", "copies", "position", "n_words", "spans", "items", "n_hit", "contaminated", "score", "lang_pred", "shard", "tier", "shard_rows", "manifest_version", "_row", "_key", "n_lines", "dropped_lines", "_found"]


@pytest.fixture(scope="module")
def clashing(spark, docs):
    return docs.withColumns({c: F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in CLASHES}).cache()


def test_columns_that_clash_with_added_ones(spark, clashing):
    bench = spark.createDataFrame([("a", corpus()[2][1])], "item_id string, text string")
    model = language_id.train(clashing)
    made = {
        "mix": (mixing.mix(clashing), ["n_tokens", "weight", "copies", "position"]), "identify": (language_id.identify(clashing, model), ["score", "lang_pred"]),
        "nothing learnt": (language_id.identify(clashing, None), ["score", "lang_pred"]), "shard": (sharding.shard(clashing), ["shard", "tier", "shard_rows", "manifest_version"]),
        "find": (decontaminate.find_windows(clashing, bench, clashing.columns), ["n_words", "spans", "items"]), "lines": (line_dedup.line_dedup(clashing), ["n_lines", "dropped_lines"]),
    }
    for name, (found, added) in made.items():
        rows = found.collect()
        assert len(rows) == len(corpus()), name
        for c in added:
            assert {r[f"{c}_in"] for r in rows} == {f"{c} of {'-' if i is None else i}" for i, *_ in corpus()}, (name, c)


@pytest.mark.parametrize("name", ["language_id", "near_dedup", "decontaminate", "mixing", "sharding"])
def test_pipeline_stages(spark, docs, clashing, empty, name, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([("a", corpus()[2][1]), (None, None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = dict(corpus_pipeline.STAGES)[name]
    for given in (docs, clashing):
        got = stage(spark, given, str(tmp_path))
        if name != "sharding":
            assert got.columns == given.columns
        rows = [tuple(r)[:5] for r in got.collect()]
        all_rows = Counter(corpus())
        want = {
            "language_id": Counter({r: n for r, n in all_rows.items() if r[1] and any(c.isalpha() for c in r[1])}),
            "decontaminate": Counter({r: n for r, n in all_rows.items() if r[1] != corpus()[2][1]}),
            "sharding": all_rows,
        }.get(name)
        if want:
            assert Counter(rows) == want
        elif name == "mixing":
            assert set(rows) == set(all_rows) and all(n >= all_rows[r] for r, n in Counter(rows).items())
        else:
            assert Counter(rows) == brute_near_dedup(corpus())
    assert stage(spark, empty, str(tmp_path)).count() == 0


def brute_near_dedup(rows):
    """Rows that stay where any two with equal sets of five-word shingles, or with a Jaccard similarity of 0.8 or more, are linked."""
    sets = []
    for r in rows:
        ws = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]+", lambda m: m[0].lower(), r[1] or "")) if w]
        sets.append(frozenset(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = defaultdict(list)
    for k, r in enumerate(rows):
        groups[find(k)].append(r)
    return Counter(min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values())


def test_equal_fingerprints_need_similar_sets(spark):
    """A shingle that makes up most of a text decides all bits of its fingerprint; what else the text holds still counts."""
    many = "same " * 60
    rest = [" ".join(f"r{k}x{i}" for i in range(30)) for k in range(3)]
    rows = [(k, many + r) for k, r in enumerate([*rest, rest[2]])] + [(9, many + "same " * 9 + rest[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_groups(docs, words=5, lanes=3, max_bits=40, similarity=0.8).collect()}
    assert len({f for f, _ in got.values()}) == 1
    assert {i: c for i, (_, c) in got.items()} == {0: 0, 1: 1, 2: 2, 3: 2, 9: 2}


def test_sets_of_a_hot_node_are_compared(spark):
    sets = spark.createDataFrame([(0, list(range(10)))] + [(k, list(range(10 - k % 4))) for k in range(1, 3000)], "node long, shingles array<long>")
    pairs = spark.createDataFrame([(0, k) for k in range(1, 3000)], "u long, v long")
    assert {r.v for r in simhash.similar(pairs, sets, 0.8).collect()} == {k for k in range(1, 3000) if k % 4 < 3}


def test_near_copies_are_dropped(spark):
    import corpus_pipeline

    rng = random.Random(4)
    found, total = Counter(), Counter()
    rows = []
    for k in range(300):
        words = [f"w{rng.randrange(10**5)}" for _ in range(300)]
        rows.append((2 * k, " ".join(words)))
        for place in rng.sample(range(300), k % 3 * 3):  # 0, 3 or 6 words: similarity 1, about 0.9, about 0.8
            words[place] = "changed"
        rows.append((2 * k + 1, " ".join(words)))
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    for k in range(300):
        total[k % 3] += 1
        found[k % 3] += 2 * k + 1 not in kept
    assert all(2 * k in kept for k in range(300)) and found[0] == total[0] and found[1] >= 0.5 * total[1]


@pytest.mark.parametrize("small", [False, True])
def test_no_similar_set_is_missed(spark, monkeypatch, small):
    """Copies around the threshold, a family of one template and a phrase in all texts: what stays is what brute force leaves."""
    import corpus_pipeline

    if small:  # rounds of stars first, blocks of few sets, few shingles known as common
        for name, value in (("PAIRS", 0), ("PREFIX_BLOCK", 3), ("COMMON", 5)):
            monkeypatch.setattr(simhash, name, value)
    rng, texts = random.Random(6), []
    phrase = [f"p{k}" for k in range(15)]
    for k in range(60):
        words = phrase + [f"w{rng.randrange(10**5)}" for _ in range(60 + 5 * k)]
        texts.append(list(words))
        for place in rng.sample(range(len(words)), max(1, len(words) // 47)):
            words[place] = f"x{rng.randrange(10**5)}"
        texts.append(words)
    family = [f"f{k}" for k in range(80)]
    for _ in range(60):
        texts.append([f"y{rng.randrange(10**5)}" if rng.random() < 0.02 else w for w in family])
    rows = [(k, " ".join(w)) for k, w in enumerate(texts)]
    rng.shuffle(rows)
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    want = brute_near_dedup(rows)
    assert Counter(map(tuple, got)) == want and 70 < len(want) < 110

def test_sets_meet_at_the_places_that_their_similarity_asks_for(spark):
    """Sets that share only shingles late among their first ones can't be similar, and aren't paired; those at the threshold are."""
    rows = []
    for node, shingles in ((1, range(100)), (2, range(100, 200)), (3, range(200, 300))):
        rows += [(s, node, 100, at) for at, s in enumerate(list(shingles)[:21])]
    rows += [(900, 1, 100, 18), (900, 2, 100, 17)]  # similarity 0.8 needs 89 of 100 shared, so one of the first 12
    rows += [(901, 2, 100, 11), (901, 3, 100, 3)]
    of = spark.createDataFrame([(*r, r[1], 2) for r in rows], "shingle long, node long, n int, at int, label long, size long")
    assert [(r.u, r.v) for r in simhash._pairs(of, 0.8).collect()] == [(2, 3)]


def test_versions_stay_readable_until_they_expire(spark, tmp_path, docs):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store", target_bytes=1 << 20, fan_in=2)
    for _ in range(3):
        store.append(docs.repartition(2))
    before = store.version()
    last = store.compact(docs.schema)
    old = [r.path for r in store.manifest(before).collect()]
    assert last > before and spark.read.schema(docs.schema).parquet(*old).count() == 3 * len(corpus())
    every = {r.path for v in range(1, last) for r in store.manifest(v).collect()}
    assert set(old) <= every and store.expire(last) == len(every - {r.path for r in store.manifest().collect()})
    assert store.read(docs.schema).count() == 3 * len(corpus())


def test_groups_that_compaction_merges(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store", target_bytes=100, fan_in=3)
    sizes = {"a": 9, "b": 10, "c": 12, "d": 26, "e": 1, "f": 60, "g": 11, "h": 25}
    shards = spark.createDataFrame([(k, k, int(math.log(n) / math.log(3)), 1, n, 0) for k, n in sizes.items()], sharding.MANIFEST)
    got = defaultdict(set)
    for r in store.plan(shards, False).collect():
        got[r.group].add(r.shard)
    small = {k: n for k, n in sizes.items() if n < 50}
    want = defaultdict(set)
    for tier in {int(math.log(n) / math.log(3)) for n in small.values()}:
        members = sorted((n, k) for k, n in small.items() if int(math.log(n) / math.log(3)) == tier)
        upto = 0
        if len(members) >= 3:
            for n, k in members:
                upto += n
                want[tier, (upto - 1) // 100].add(k)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, (g for g in want.values() if len(g) > 1)))


def test_training_takes_rows_without_ids(spark):
    rows = [(None, "the same text of many words", "en")] * 50 + [(7, "der gleiche Satz mit vielen Worten", "de")] * 50 + [(7, "the other text", "en")]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_docs=3)
    assert model.langs == ["de", "en"] and [x for x, _ in model.classify([b"the same text of many words", b"der gleiche Satz mit vielen Worten"])] == ["en", "de"]


def test_packed_arrays_may_be_empty():
    given = [np.zeros(0, np.int64), np.arange(5), np.zeros(0, np.float64), np.array([1.5])]
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(katz.unpack(katz.pack(*given)), given, strict=True))
