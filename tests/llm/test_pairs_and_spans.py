"""The Jaccard join, decontamination, personal data and the pipeline, against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from millrace.llm import components, decontaminate, jaccard_join, pii
from millrace.llm.common import ROW, with_row
from millrace.session import ship


def words(text):
    return (text or "").encode().lower().split()


def shingles(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def groups(sets):
    """Component number of each row, by comparing all pairs."""
    top = list(range(len(sets)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                top[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(sets))]


def near_copies(seed=3):
    rng = random.Random(seed)
    common = "this passage of a dozen words or so is found in very many documents".split()
    texts = [None, "", " \n", "one", "One", "a b c d", "a b c d", "A b c d e", "x" * 30_000]
    for _ in range(6):
        base = [f"w{rng.randrange(10_000)}" for _ in range(rng.randint(20, 120))]
        for _ in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = f"v{rng.randrange(10_000)}"
            texts.append(" ".join(copy))
        texts.append(" ".join(base + common))
    for _ in range(15):
        texts.append(" ".join(common + [f"u{rng.randrange(10_000)}" for _ in range(rng.randint(0, 6))]))
    texts += [texts[12]] * 9 + [texts[20].upper()]
    return texts


def test_join_finds_the_components_of_all_pairs(spark, staging):
    texts = near_copies()
    ids = [None if i % 11 == 5 else 1000 - i for i in range(len(texts))]
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in zip(ids, texts)], "doc_id bigint, text string, n int, cls string")
    got = jaccard_join.similar_documents(df, staging=staging).collect()
    numbers = {r[ROW]: (r["doc_id"], r["text"]) for r in with_row(df).collect()}
    rows = sorted(numbers)
    sets = [shingles(numbers[r][1]) for r in rows]
    members = defaultdict(list)
    for r, g in zip(rows, groups(sets)):
        members[g].append(r)
    want = {}
    for g, own in members.items():
        name = min((numbers[r][0] for r in own if numbers[r][0] is not None), default=None)
        for r in own:
            want[r] = (numbers[r][0], len(shingles(numbers[r][1])), name)
    assert {r[ROW]: (r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == want
    stay = jaccard_join.one_per_component(df, staging=staging)
    assert stay.columns == df.columns
    assert stay.count() == len(members)


def test_join_of_an_empty_table(spark, staging):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert jaccard_join.similar_documents(df, staging=staging).count() == 0


def test_similar_sets_share_a_prefix_token_under_any_order():
    rng = random.Random(8)
    for _ in range(2000):
        n = rng.randint(1, 40)
        a = set(rng.sample(range(100), n))
        b = set(list(a)[: rng.randint(1, n)]) | set(rng.sample(range(100, 200), rng.randint(0, 5)))
        if 100 * len(a & b) >= 80 * len(a | b):
            order = {t: rng.random() for t in a | b}
            firsts = [set(sorted(s, key=order.get)[: jaccard_join.prefix_length(len(s))]) for s in (a, b)]
            assert firsts[0] & firsts[1]


@pytest.mark.parametrize("run", [1 << 20, 9])
def test_components_of_paths_stars_and_loops(spark, staging, monkeypatch, run):
    """In one run, and in several that meet in rounds of stars."""
    ship(spark)
    monkeypatch.setattr(components, "LOCAL_EDGES", run)
    edges = [(i, i + 1) for i in range(30)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (300, 301), (301, 300), (302, 301)]
    rng = random.Random(1)
    edges = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in edges]
    rng.shuffle(edges)
    got = components.components(spark.createDataFrame(edges, "a bigint, b bigint"), staging).collect()
    want = {i: 0 for i in range(31)} | {100: 100} | {200 + i: 100 for i in range(50)} | {300: 300, 301: 300, 302: 300}
    assert {r["node"]: r["label"] for r in got} == want and len(got) == len(want)


def test_stars_of_random_edges():
    import numpy as np

    rng = random.Random(4)
    for n in (0, 1, 5, 300):
        edges = [(rng.randrange(-n, n + 1), rng.randrange(-n, n + 1)) for _ in range(n)]
        nodes, roots = components.local_stars(np.array([a for a, _ in edges], np.int64), np.array([b for _, b in edges], np.int64))
        label = {x: x for e in edges for x in e}
        for _ in range(len(edges) + 1):
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
        assert dict(zip(nodes.tolist(), roots.tolist())) == label


def test_jobs_do_not_follow_the_links(spark, staging):
    """The number of jobs is that of the steps: components in one run take one each."""
    ship(spark)
    df = spark.createDataFrame(list(enumerate(near_copies())), "doc_id bigint, text string")
    spark.sparkContext.setJobGroup("count-jobs", "count-jobs")
    try:
        jaccard_join.similar_documents(df, staging=staging).collect()
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("count-jobs"))
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert jobs < 100, jobs


def leaks(texts, items):
    held = Counter(s for t in items.values() for s in shingles(t))
    import math

    weigh = lambda s: 1 / (1 + math.log2(held[s])) if s in held else 1.0
    out = []
    for text in texts:
        w, found = words(text), []
        for i, t in items.items():
            n = len(words(t))
            size = min(5, n)
            if not n or len(w) < size:
                continue
            own = shingles(t)
            run = [tuple(w[k:k + size]) for k in range(len(w) - size + 1)]
            span = min(n - size + 1, len(run))
            for k in range(len(run) - span + 1):
                b = set(run[k:k + span])
                if sum(map(weigh, own & b)) >= (0.8 - 1e-12) * sum(map(weigh, own | b)):
                    found.append(i)
                    break
        out.append(sorted(found))
    return out


def test_leaks_are_those_of_every_window(spark, staging):
    rng = random.Random(2)
    items = {k: " ".join(f"b{rng.randrange(500)}" for _ in range(n)) for k, n in enumerate([3, 5, 12, 30, 31, 60, 200])}
    items[20], items[21] = items[3], items[4] + " more"
    texts = [None, "", "one two", items[0], items[2].upper()]
    for _ in range(60):
        copy = items[rng.choice(list(items))].split()
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(len(copy))] = "changed"
        pad = [f"p{rng.randrange(900)}" for _ in range(rng.randint(0, 80))]
        at = rng.randint(0, len(pad))
        texts.append(" ".join(pad[:at] + copy + pad[at:]))
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id bigint, text string, hit int, item_id int")
    bench = spark.createDataFrame([*items.items(), (50, None), (51, "")], "item_id bigint, text string")
    got = {r["hit"]: r["item_ids"] for r in decontaminate.find_leaks(df, bench, staging=staging).collect()}
    rows = {r[ROW]: r["doc_id"] for r in with_row(df).collect()}
    want = {i: ids for i, ids in enumerate(leaks(texts, items)) if ids}
    assert {rows[h]: ids for h, ids in got.items()} == want
    kept = decontaminate.clean(df, bench, staging=staging)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - set(want)
    decontaminate.SLICE_ITEMS, old = 4, decontaminate.SLICE_ITEMS
    try:
        again = decontaminate.find_leaks(df, bench, staging=staging).collect()
    finally:
        decontaminate.SLICE_ITEMS = old
    assert {r["hit"]: r["item_ids"] for r in again} == got
    assert decontaminate.clean(df, bench.limit(0), staging=staging).count() == len(texts)
    assert decontaminate.clean(df.limit(0), bench, staging=staging).count() == 0


def test_weights_of_shingles_shared_by_items_of_other_slices(spark, staging, monkeypatch):
    items, texts = {}, []
    for g in range(3):
        own = [f"w{g}x{k}" for k in range(22)]
        end = [f"e{g}x{k}" for k in range(3)]
        texts.append(" ".join(own + end))
        items[f"{g}"] = " ".join(own + [f"o{g}x{k}" for k in range(3)])
        for n in range(3):  # three items hold the three shingles that end the text
            items[f"{g}-{n}"] = " ".join(own[18:] + end + [f"r{g}x{n}x{k}" for k in range(20)])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    bench = spark.createDataFrame(list(items.items()), "item_id string, text string").coalesce(1)
    found = []
    for size in (len(items), 1):
        monkeypatch.setattr(decontaminate, "SLICE_ITEMS", size)
        found.append({r["hit"]: (r["item_ids"], round(r["similarity"], 9)) for r in decontaminate.find_leaks(df, bench, staging=staging).collect()})
    assert [ids for _, (ids, _) in sorted(found[0].items())] == [["0"], ["1"], ["2"]] and found[1] == found[0]


def test_multi_index_finds_all_within_the_radius():
    import numpy as np

    rng = np.random.default_rng(4)
    prints = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    tables = decontaminate._block_tables(prints)
    for _ in range(300):
        at = int(rng.integers(40))
        flips = rng.choice(64, decontaminate.RADIUS, replace=False)
        p = int(prints[at])
        for b in flips:
            p ^= 1 << int(b)
        met = set()
        for b, table in enumerate(tables):
            met.update(table.get(p >> (8 * b) & 255, np.zeros(0, int)).tolist())
        assert at in met


KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def holds(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in twice) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def base_spans(text):
    found = [(m.start(), n, m.end(), kind) for n, (kind, p) in enumerate(KINDS) for m in re.finditer(p, text or "") if holds(kind, m.group())]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))


def personal(seed=9):
    rng = random.Random(seed)
    texts = [None, "", "no data", "a@b.c_d@e.f x@y@z.com .@q.rs", "1.2.3.4.5 300.1.1.1 0255.000.1.01", "4111 1111 1111 1111 4111-1111-1111-1112",
             "😀 é +1 (375) 555-4393 ü", "+1" + " " * 50 + "2", "+" * 400, "a" * 20_000 + "@", "1" * 9000, "1 " * 4000, "mail.a_b@c" + ".d" * 500]
    for _ in range(400):
        texts.append("".join(rng.choice(["1", "23", ".", " ", "-", "+", "(", ")", "@", "a", "b.c", "_", "%", "\n", "é", "4111111111111111"]) for _ in range(rng.randint(1, 40))))
    return texts


def test_base_spans_are_those_of_the_patterns(spark, staging):
    texts = personal()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, start string, hit int")
    found = pii.find_spans(df, staging=staging)
    numbered = {r[ROW]: r["doc_id"] for r in with_row(df).collect()}
    got = {numbered[r["hit"]]: r["s"] for r in found.select("hit", pii.written(found["base"]).alias("s")).collect()}
    assert {i: s for i, s in got.items() if s} == {i: base_spans(t) for i, t in enumerate(texts) if base_spans(t)}
    assert pii.find_spans(df.limit(0), staging=staging).count() == 0


def test_learnt_spans_are_added_and_redacted(spark, staging):
    rng = random.Random(4)
    texts = [f"call me at +1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)} today" for _ in range(200)]
    texts += [f"on 20{rng.randrange(10, 25)}-0{rng.randrange(1, 9)}-1{rng.randrange(0, 9)} 123456 we met" for _ in range(200)]
    texts += ["phone (375) 555-4393 or a@b.com", None, "nothing"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    done = {r["doc_id"]: r["redacted"] for r in pii.redact(df, staging=staging).collect()}
    assert done[400] == "phone [phone] or [email]" and done[401] == "" and done[402] == "nothing"
    assert done[0] == "call me at [phone] today" and done[200] == texts[200]


def card(rng, valid=True):
    digits = "4" + "".join(str(rng.randrange(10)) for _ in range(14))
    last = next(d for d in range(10) if holds("card", f"{digits}{d}"))
    return f"{digits}{last if valid else (last + rng.randrange(1, 10)) % 10}"


def test_adjacent_cards_are_added_beside_numbers_that_fail(spark, staging):
    rng = random.Random(6)
    texts = [f"so {card(rng)} was" for _ in range(150)] + [f"so {card(rng, False)} was" for _ in range(150)]
    want = {}
    for size, gap in ((1, " "), (1, "-"), (1, "."), (2, " "), (3, " ")):
        for valid in range(1 << size + 1):
            parts = [card(rng, valid >> k & 1) for k in range(size + 1)]
            text = "so " + gap.join(parts) + " was"
            if base_spans(text) == "":
                want[len(texts)] = [(3 + 17 * k, 19 + 17 * k) for k in range(size + 1) if valid >> k & 1]
                texts.append(text)
    cut = card(rng), card(rng)
    for text in (f"x{cut[0]} {cut[1]}", f"{cut[0]} {cut[1]}x"):  # one of them runs into a letter
        want[len(texts)] = [(18, 34)] if text[0] == "x" else [(0, 16)]
        texts.append(text)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    numbered = {r[ROW]: r["doc_id"] for r in with_row(df).collect()}
    got = {numbered[r["hit"]]: [(s["start"], s["end"]) for s in r["added"] if s["kind"] == "card"]
           for r in pii.find_spans(df, staging=staging).collect() if r["added"]}
    assert got == {i: spans for i, spans in want.items() if spans}


def test_base_digest_of_the_query(spark, data_dir):
    from millrace.llm.registry import QUERIES

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()}
    for r in QUERIES["op7_pii"](spark, data_dir).collect():
        assert r["base_sha256"] == hashlib.sha256(base_spans(docs[r["doc_id"]]).encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    from millrace.llm import bpe

    tokens = bpe.read_ranks(bpe.rank_file())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={}, mergeable_ranks={t: i for i, t in enumerate(tokens) if t})


def test_pipeline_equals_its_stages_by_brute_force(spark, data_dir, library):
    import corpus_pipeline
    from tests.llm.test_rules_lines_shards import dedup

    rules = spark.read.parquet(f"{data_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in corpus_pipeline.reject_low_quality(spark, rules, data_dir).collect()]
    rows = [(i, t) for i, t, _, _ in dedup(rows).elements()]
    sets = [shingles(t) for _, t in rows]
    best = {}
    for (i, t), g, s in zip(rows, groups(sets), sets):
        key = g if s else ("empty", i)
        if key not in best or i < best[key][0]:
            best[key] = (i, t)
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{data_dir}/benchmark.parquet").collect()}
    rows = sorted(best.values())
    want = {i: library.encode_ordinary(t) for (i, t), hits in zip(rows, leaks([t for _, t in rows], items)) if not hits}
    assert {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, data_dir).collect()} == want


def test_pipeline_stages_keep_the_columns(spark, data_dir):
    import corpus_pipeline

    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0)], spark.read.parquet(f"{data_dir}/documents.parquet").schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, data_dir).columns == odd.columns
