"""Approximate search, containment, bounded caches, late data, sketches, the table function, VARIANT, lists, fallbacks: each against a plain version."""

from __future__ import annotations

import datetime as dt
import math
import random
import re
from collections import Counter, OrderedDict

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from lexiloom.functions import text as X
from lexiloom.functions import variants
from lexiloom.operators import chunking, contain, ivf, lexical, logs, refs, situations, sketches, steps, vector
from lexiloom.plans import catalog
from lexiloom.plans.retrieval_queries import chunks, query_vectors, questions
from lexiloom.session import table
from lexiloom.sources import documents
from lexiloom.streaming import state

SF, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
EN = X._nfc


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# ------------------------------------------------------------------ vectors


def test_ivf_recall_filters_and_exact_scores(spark, tmp_path):
    vectors, q = table(spark, LARGE, "embeddings"), query_vectors(spark, LARGE)
    ivf.build(vectors, f"{tmp_path}/i")
    index = spark.read.parquet(f"{tmp_path}/i/lists")
    assert index.count() == vectors.count() and index.select("list").distinct().count() > 20
    for where in (None, F.col("label") == 3):
        exact = {(r.query_id, r.doc): r.score for r in vector.dense_top_k(vectors, q, 10, where=where).collect()}
        got = {(r.query_id, r.doc): r.score for r in ivf.search(spark, f"{tmp_path}/i", q, 10, where).collect()}
        assert len(got) == len(exact) == 10 * q.count()
        assert len(got.keys() & exact.keys()) >= 0.9 * len(exact)
        assert all(got[k] == pytest.approx(exact[k], abs=2e-6) for k in got.keys() & exact.keys())
    rows = index.where(F.col("list").isin(1, 2))
    assert "PartitionFilters: [list" in plan_of(rows.where("label = 3")) and "PushedFilters: [IsNotNull(label)" in plan_of(rows.where("label = 3"))


def test_ivf_widens_to_the_exact_answer(spark, tmp_path):
    """So few rows pass that all lists are read: then hits are those of the exact search."""
    vectors = table(spark, SF, "embeddings").withColumn("rare", F.col("vec_id").isin(3, 77, 200, 401))
    ivf.build(vectors, f"{tmp_path}/i", lists=16)
    q = query_vectors(spark, SF)
    got = ivf.search(spark, f"{tmp_path}/i", q, 10, F.col("rare"), probes=1)
    key = lambda d: sorted((r.query_id, r["rank"], r.doc, r.score) for r in d.collect())
    assert key(got) == key(vector.dense_top_k(vectors, q, 10, where=F.col("rare")))


def test_ivf_odd_rows(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0, 0.0]), (4, [0.0, 0.0])], "vec_id long, embedding array<double>")
    ivf.build(rows, f"{tmp_path}/i", lists=3)
    assert spark.read.parquet(f"{tmp_path}/i/lists").count() == 4
    q = spark.createDataFrame([(9, [1.0, 0.1]), (10, None)], "query_id long, qv array<double>")
    assert [r.doc for r in ivf.search(spark, f"{tmp_path}/i", q, 2).orderBy("rank").collect()] == [1, 3]
    ivf.build(rows.limit(0), f"{tmp_path}/e")
    assert ivf.search(spark, f"{tmp_path}/e", q, 2).collect() == []


def test_codes_are_bytes_and_recall_is_kept(spark):
    vectors, q = table(spark, LARGE, "embeddings"), query_vectors(spark, LARGE)
    codes = vector.code_table(vectors)
    assert dict(codes.dtypes)["code"] == "binary" and {len(r.code) for r in codes.collect()} == {64}
    exact = {(r.query_id, r.doc) for r in vector.dense_top_k(vectors, q, 10).collect()}
    for given in (None, codes):
        got = {(r.query_id, r.doc) for r in vector.quantized_top_k(vectors, q, 10, codes=given).collect()}
        assert len(got & exact) >= 0.99 * len(exact)
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(9, [1.0, 0.1])], "query_id long, qv array<double>")
    assert [r.doc for r in vector.quantized_top_k(few, asked, 5).collect()] == [1]


def test_fallback_is_two_searches_in_one(spark):
    rows, q = chunks(spark, SF), questions(spark, SF).limit(30)
    rare = F.col("act_id") == 3
    first = lexical.bm25_search(rows, q, 5, rare, doc="doc").collect()
    others = {r.query_id for r in first}
    want = {(r.query_id, r["rank"], r.doc, r.score) for r in first} | {(r.query_id, r["rank"], r.doc, r.score) for r in lexical.bm25_search(rows, q, 5, doc="doc").collect() if r.query_id not in others}
    found = lexical.bm25_search(rows, q, 5, doc="doc", prefer=rare)
    assert {(r.query_id, r["rank"], r.doc, r.score) for r in found.collect()} == want
    none = lexical.bm25_search(rows, q, 5, doc="doc", prefer=F.col("act_id") == -1)
    assert none.where("preferred").count() == 0 and none.count() == lexical.bm25_search(rows, q, 5, doc="doc").count()
    assert plan_of(none.select("query_id")).count("FileScan parquet") == 1


# ------------------------------------------------------------------ containment


def test_containment_equals_all_pairs(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abআ ") for _ in range(rng.randint(1, 9)))
    texts = [(i, " ".join(word() for _ in range(rng.randint(0, 12)))) for i in range(60)] + [(60, None), (61, ""), (7, "ab ba")]
    parts = [(i, word()) for i in range(60)] + [(60, None), (61, ""), (62, "ab"), (62, "ab"), (63, "zzzzzzz"), (64, "b")]
    t, p = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(parts, "no long, part string")
    df = contain.containment_join(t, "text", p, "part")
    got = Counter((r.id, r.text, r.no, r.part) for r in df.collect())
    assert got == Counter((i, a, n, b) for i, a in texts for n, b in parts if a is not None and b and b in a)
    assert "NestedLoop" not in plan_of(df) and "Cartesian" not in plan_of(df)
    assert contain.containment_join(t, "text", p.limit(0), "part").collect() == []


def test_titles_are_resolved_as_by_a_loop(spark):
    rng = random.Random(6)
    names = ["penal code", "penal code amendment rules", "evidence", "evidence and proof", "land survey", "land survey of the north", "marine fishing"]
    acts = [(i, f"The {n.title()} Act, {1900 + i}", i % 3 == 0) for i, n in enumerate(names)]
    asked = [(i, " and ".join(rng.choice([f"the {n} act {rng.randint(1, 9)}", n, "nothing"]) for n in rng.sample(names, 3))) for i in range(40)]
    a, q = spark.createDataFrame(acts, "act_id long, title string, repealed boolean"), spark.createDataFrame(asked, "query_id long, question string")
    stems = sorted(((r.stem, r.act_id) for r in refs.title_stems(a).collect()), key=lambda s: (-len(s[0]), s[0]))
    want = set()
    for i, text in asked:
        left, found = text.lower(), []
        for stem, act in stems:
            if stem in left:
                found.append(act)
                left = left.replace(stem, " ")
        want |= {(i, act, place) for place, act in enumerate(found[:3], 1)}
    df = refs.resolve_acts(q, a)
    got = {(r.query_id, r.act_id, r.place) for r in df.collect()}
    named = {i for i, _, _ in want}
    assert {g for g in got if g[0] in named} == want
    best = {r.phrase: r.act_id for r in refs.principal_act(a, spark.createDataFrame([("evidence",), ("land survey",), ("absent",)], "phrase string")).collect()}
    loop = {p: min((rep, len(t), i) for i, t, rep in acts if p in t.lower())[-1] for p in ("evidence", "land survey")}
    assert best == loop


# ------------------------------------------------------------------ streams


def lru(rows, max_size, ttl):
    """The cache as one ordered dictionary a shard."""
    held, out = OrderedDict(), {}
    for seq, key, value, kind, at in sorted(rows, key=lambda r: (r[4], r[0])):
        dropped, hit = 0, None
        if kind == "put":
            held[key] = (at, value)
            held.move_to_end(key)
            while len(held) > max_size:
                dropped += at - held.popitem(last=False)[1][0] <= ttl
        else:
            hit = key in held and at - held[key][0] <= ttl
            if hit:
                held.move_to_end(key)
            else:
                held.pop(key, None)
        out[seq] = (hit, held[key][1] if hit else None, dropped)
    return out


def test_bounded_cache_equals_ordered_dictionaries_over_restarts(spark, tmp_path):
    rng = random.Random(3)
    begin = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows, at = [], 0.0
    for seq in range(1200):
        at += 5000.0 if seq in (400, 800) else rng.random() * 2
        rows.append((seq, f"k{rng.randrange(40)}", f"v{seq}", rng.choice(["put", "get", "get"]), at))
    df = spark.createDataFrame([(*r[:4], begin + dt.timedelta(seconds=r[4])) for r in rows], "seq long, key string, value string, kind string, ts timestamp")
    shard = {r.key: r.shard for r in df.select("key", F.pmod(F.xxhash64("key"), F.lit(3)).alias("shard")).distinct().collect()}
    want = {}
    for s in range(3):
        want |= lru([r for r in rows if shard[r[1]] == s], 6, 200.0)
    arrivals = [df.where(F.col("seq").between(i * 300, i * 300 + 299)) for i in range(4)]
    read = lambda: spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    with state.rocksdb(spark):
        got = state.in_steps(arrivals, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", lambda s: state.bounded_cache(s, 6, 200.0, 3), read)
    assert {r.seq: (r.hit, r.value, r.dropped) for r in got.collect()} == want
    assert sum(d for _, _, d in want.values()) > 50 and sum(bool(h) for h, _, _ in want.values()) > 50


def test_registered_cache_equals_ordered_dictionaries(spark):
    e = table(spark, SF, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.pmod(F.xxhash64(F.col("user_id").cast("string")), F.lit(4)).alias("shard")).collect()
    want = {}
    for s in range(4):
        put = lambda r: r.event_type in ("signup", "purchase")
        want |= lru([(r.event_id, str(r.user_id), str(r.event_id), "put" if put(r) else "get", r.us / 1e6) for r in e if r.shard == s], 20, 86400.0)
    got = {r.seq: (r.hit, r.value, r.dropped) for r in catalog.QUERIES["bounded_cache"](spark, SF).collect()}
    assert got == want


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    at = lambda h: dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(hours=h)
    kind = "event_id long, ts timestamp, event_type string, value double"
    steps_ = [[(1, 0, 1.0), (2, 11, 1.0)], [(3, 30, 1.0), (4, 9, 2.0)], [(5, 8, 4.0), (6, 26, 8.0), (7, 60, 1.0)]]
    arrivals = [spark.createDataFrame([(i, at(h), "x", v) for i, h, v in s], kind) for s in steps_]
    read = lambda: spark.readStream.schema(kind).parquet(f"{tmp_path}/in")
    got = state.in_steps(arrivals, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", lambda s: state.windowed_counts(s, "12 hours", "6 hours", "10 hours"), read)
    found = {(r.start.replace(tzinfo=dt.timezone.utc) - at(0)).total_seconds() / 3600: (r.n, r.total) for r in got.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", "total").collect()}
    # row 5 (8 h) comes when the watermark is at 20 h: both its windows, to 12 h and to 18 h, are closed
    assert found == {-6.0: (1, 1.0), 0.0: (3, 4.0), 6.0: (2, 3.0), 18.0: (1, 8.0), 24.0: (2, 9.0), 30.0: (1, 1.0)}


# ------------------------------------------------------------------ sketches


def test_small_sketches_stay_within_their_bounds(spark):
    rng = random.Random(1)
    rows = [(i % 5, "a" if i % 3 else "b", int(rng.paretovariate(0.6)) % 5000, rng.random()) for i in range(20_000)]
    df = spark.createDataFrame(rows, "day int, kind string, item int, value double").withColumn("ts", F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, day)"))
    size = {"registers": 10, "values": 200, "items": 100}
    kept = sketches.daily(df, ["kind"], "item", "value", **size)
    assert kept.count() == 10
    for r in sketches.combined(kept, ["kind"], 5, (0.5, 0.9), size["items"]).collect():
        mine = [x for x in rows if x[1] == r.kind]
        exact, bound = Counter(x[2] for x in mine), sketches.error_bounds(len(mine), **size)
        assert r.n == r.n_items == len(mine) and abs(r.distinct - len(exact)) <= bound["distinct"] * len(exact)
        values = sorted(x[3] for x in mine)
        for rank, q in zip((0.5, 0.9), r.quantiles, strict=True):
            assert abs(sum(v <= q for v in values) / len(values) - rank) <= 3 * bound["rank"]
        assert len(r.tops) == 5 and all(abs(t["count"] - exact[t["item"]]) <= bound["tops"] for t in r.tops)
        assert r.tops[0]["item"] == exact.most_common(1)[0][0]


# ------------------------------------------------------------------ table function, VARIANT


def test_rechunked_units_equal_packing(spark):
    docs = table(spark, SF, "documents").limit(60)
    units = chunking.clause_units(docs)
    own = {}
    for r in sorted(units.collect(), key=lambda r: (r.doc, r.unit)):
        own.setdefault(r.doc, []).append(r.body)
    got = {(r.doc, r.size, r.part): r.body for r in chunking.rechunk(units, [100, 700, 5000]).collect()}
    want = {(d, s, i): b for d, bodies in own.items() for s in (100, 700, 5000) for i, b in enumerate(chunking.pack_units(bodies, s), 1)}
    assert got == want


def test_table_function_checks_its_arguments(spark):
    units = spark.createDataFrame([("x", 1, "one two"), ("x", 2, None), ("y", 1, "")], "doc string, unit int, body string")
    got = chunking.rechunk(units, [3])
    assert got.schema["doc"].dataType.simpleString() == "string" and [(r.doc, r.part, r.body) for r in got.orderBy("part").collect()] == [("x", 1, "one"), ("x", 2, "two")]
    for bad, sizes in ((units.select("doc", "body"), [3]), (units, [0]), (units.withColumn("body", F.lit(1)), [3])):
        with pytest.raises((AnalysisException, ValueError)):
            chunking.PackedUnits(bad.asTable(), F.array(*map(F.lit, sizes))).collect()


def test_variants_of_broken_and_odd_text(spark, tmp_path):
    texts = [None, "", "no json", '{"score": 2, "why": "x"}', 'so {"score": "3"} ok', "{broken", '{"tool": "search", "args": {"q": "a", "k": 5}} and more', '{"tool": 4, "args": {}}', "[1, 2]", '{"score": {"a": 1}}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    judged = variants.judge_reply(F.col("t"), {"score": "double", "why": "string"})
    call = variants.tool_call(F.col("t"))
    got = {r.i: r for r in df.select("i", judged.alias("j"), call["tool"].alias("tool"), variants.field(call["args"], ".k", "int").alias("k")).collect()}
    assert [got[i].j is None for i in range(10)] == [True, True, True, False, False, True, False, False, True, False]
    assert tuple(got[3].j) == (2.0, "x") and tuple(got[4].j) == (3.0, None) and tuple(got[9].j) == (None, None)
    assert (got[6].tool, got[6].k) == ("search", 5) and got[7].tool is None
    for name, body in (("a", '{"gaps": [{"q": 1}, {"q": 2}]}'), ("b", '{"gaps": 3}'), ("c", "{oops"), ("d", "")):
        (tmp_path / f"{name}.json").write_text(body)
    gaps = documents.read_gaps(spark, str(tmp_path))
    assert sorted((r.file, r.q) for r in gaps.select("file", variants.field(F.col("gap"), ".q", "int").alias("q")).collect()) == [("a.json", 1), ("a.json", 2)]
    assert documents.read_documents(spark, str(tmp_path)).where("doc is null").count() == 1


# ------------------------------------------------------------------ lists

ITEM = re.compile(r"^\s*(?:[0-9০-৯]{1,2}[.)।]|[-*•‣–])\s+(.*\S)\s*$")
HEADING = re.compile(r"^\s*(?:#{1,4}\s+\S|\*\*[^*]+\*\*[:ঃ]?\s*$)")


def plain_list(lines):
    """One line after another."""
    items, used, after_blank = [], 0, False
    for n, line in enumerate(lines):
        if line.strip() == "":
            after_blank = True
        elif hit := ITEM.match(line):
            items, used, after_blank = [*items, hit[1]], n + 1, False
        elif items and not after_blank and not HEADING.match(line):
            items, used = [*items[:-1], f"{items[-1]} {line.strip()}"], n + 1
        else:
            break
    return [re.sub(r"\*\*|__", "", x).strip() for x in items], used


def test_lists_equal_a_loop_over_lines(spark):
    rng = random.Random(7)
    kinds = ["- one", "2. two __x__", "৩। তিন", "* **bold** it", "goes on", "  indented  ", "", " \t", "# Head", "**Strong**:", "-no item", "12) twelve", "• dot"]
    rows = [(i, [rng.choice(kinds) for _ in range(rng.randint(0, 9))]) for i in range(600)]
    got = spark.createDataFrame(rows, "i int, l array<string>").select("i", steps.list_items(F.col("l")).alias("f")).collect()
    assert {r.i: (r.f["items"], r.f["used"]) for r in got} == {i: plain_list(lines) for i, lines in rows}
    assert spark.createDataFrame([(None,)], "l array<string>").select(steps.list_items(F.col("l")).alias("f")).first().f["items"] == []


def test_answers_are_split(spark):
    texts = [
        "Answer [1].\n\n---\n**What you can do:**\n\n1. Go to court [2][1][2]\n   with papers\n- Ask **legal aid** [10].\n\nAfter.\n\n## Practical tips\n- Keep copies\n* Call 16430\n- Write\n- Third\n- Fourth",
        "উত্তর।\nকরণীয়ঃ\n১। থানায় যান [1]\n\nব্যবহারিক পরামর্শ\n- কপি রাখুন",
        "No lists here.\n\n- a bare list", "Next steps\nnot a list", None, "", "Practical tips\n\n\n- only tips",
    ]
    got = [r for r in steps.split_answers(spark.createDataFrame([(i, t, 1, "c") for i, t in enumerate(texts)], "i int, text string, lines int, cites string")).orderBy("i").collect()]
    assert [(s["text"], s["cites"]) for s in got[0].steps] == [("Go to court [2][1][2] with papers", [1, 2]), ("Ask legal aid [10].", [10])]
    assert got[0].tips == ["Keep copies", "Write", "Third"] and got[0].body == "Answer [1].\n\nAfter."
    assert [s["text"] for s in got[1].steps] == [EN("থানায় যান [1]")] and got[1].tips == [EN("কপি রাখুন")] and got[1].body == EN("উত্তর।")
    assert [(r.body, r.steps, r.tips) for r in got[2:6]] == [("No lists here.\n\n- a bare list", [], []), ("Next steps\nnot a list", [], []), ("", [], []), ("", [], [])]
    assert got[6].tips == ["only tips"] and got[6].body == ""


def test_checklists(spark):
    rows = [
        (1, "What is section 5?", "Text.\nNext steps\n- do it", False, False), (2, "What is section 5?", "Text only", False, False), (3, "My landlord evicted me, what should I do?", "Text only", False, False),
        (4, "My landlord evicted me, what should I do?", "Next steps\n- x", True, False), (5, "x", None, False, False), (6, "My landlord evicted me, what should I do?", "Next steps\n- x", False, True),
    ]
    got = {r.query_id: r for r in steps.checklists(spark.createDataFrame(rows, "query_id long, question string, text string, refused boolean, general boolean")).collect()}
    assert set(got) == {1, 3, 6}
    assert [s["text"] for s in got[1].steps] == ["do it"] and got[1].body == "Text." and got[1].generic_tips
    assert got[3].steps == [] and got[3].tips == list(steps.GENERAL_TIPS["en"]) and got[3].body is None and "legal_aid" in got[3].contacts
    assert got[6].steps == [] and got[6].body is None


def test_registered_lists_equal_the_loop(spark):
    from lexiloom.plans.feature_queries import answers

    texts = {r.query_id: r.text for r in answers(spark, SF).collect()}
    got = {r.query_id: r for r in catalog.QUERIES["answer_steps"](spark, SF).collect()}
    for i, text in texts.items():
        lines = EN(text).split("\n")
        head = next(n for n, x in enumerate(lines) if x.startswith("## Next steps"))
        items, _ = plain_list(lines[head + 2 :])
        assert got[i].steps == items and math.isfinite(got[i].cites)


# ------------------------------------------------------------------ round 3

def test_followed_references_meet_few_sections_of_a_number(spark):
    """of 300 sections with one number only the first few meet the references to it."""
    own = [(i, 1, str(i % 2), ["0", "1"]) for i in range(600)] + [(0, 1, "0", ["1"])]
    s = spark.createDataFrame(own, "doc int, act_id int, number string, refs array<string>").withColumn("kind", F.lit("overview")).withColumn("act_refs", F.array(F.lit(1)))
    target = s.select("act_id", "number", F.col("doc").alias("to"))
    assert refs._first(target, ["act_id", "number"], 4, 3).count() == 9  # 0 is there twice
    got = sorted((r.doc, r.kind, r.place, r.to) for r in refs.follow_references(s).where("doc in (4, 5)").collect())
    want = [(d, k, i + 1, t) for d, k, i, t in [(d, k, i, t) for d in (4, 5) for k, ts in (("act", (0, 0, 1)), ("section", (0, 0, 2))) for i, t in enumerate(ts)]]
    assert got == want


def test_quantised_search_of_near_copies_is_exact(spark, monkeypatch):
    """300 vectors whose codes hardly differ; F9 to F15: no more scores at once than are stated."""
    rng = random.Random(5)
    rows = [(i, [1.0 + rng.random() / 500 for _ in range(16)]) for i in range(300)] + [(300 + i, [1.0] * 8 + [1.001] * 8) for i in range(40)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    q = v.where("vec_id % 50 = 0").selectExpr("vec_id as query_id", "embedding as qv")
    key = lambda df: sorted((r.query_id, r.rank, r.doc) for r in df.collect())
    want = key(vector.dense_top_k(v, q, 5))
    assert key(vector.quantized_top_k(v, q, 5)) == want
    monkeypatch.setattr(vector, "CELLS", 40)
    assert key(vector.quantized_top_k(v, q, 5)) == want and key(vector.dense_top_k(v, q, 5)) == want
    import pyarrow as pa

    assert {b.num_rows for b in vector.slices(iter([pa.record_batch({"x": list(range(100))})]), 7)} == {5}


def test_paraphrase_lookup_joins_no_pairs(spark):
    """probes go to the tasks; gates, ties and odd rows as said."""
    rng = random.Random(3)
    rows = [(i, i % 3, [rng.gauss(0, 1), rng.gauss(0, 1), 1.0], [i % 3, i % 2], 0.0 if i % 7 else -9e9) for i in range(120)] + [(200, 1, None, [1], 0.0), (201, None, [1.0, 0.0, 1.0], [1], 0.0), (202, 1, [0.0, 0.0, 1.0], None, 0.0)]
    cache = spark.createDataFrame(rows, "id long, sig int, v array<double>, evidence array<int>, ts double")
    found = logs.paraphrase_lookup(cache.where("id % 4 = 0").drop("ts"), cache, threshold=0.5)
    assert "HashJoin" not in plan_of(found) and "SortMergeJoin" not in plan_of(found)
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b)), 6)
    want = {}
    for i, s, v, e, _ in rows[:120:4]:
        near = [(cos(v, w), -j) for j, t, w, f, ts in rows[:120] if s == t and i != j and ts == 0.0 and len({*e} & {*f}) / len({*e} | {*f}) >= 0.6]
        if near and max(near)[0] >= 0.5:
            want[i] = (-max(near)[1], max(near)[0])
    assert {r.id: (r.cached, r.similarity) for r in found.collect()} == want


def test_statistics_of_many_users_and_values_are_exact(spark, tmp_path):
    """more users and values than a sketch holds."""
    import duckdb

    e = spark.range(400_000).select(F.col("id").alias("event_id"), F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, id % 4)").alias("ts"), F.expr("xxhash64(id) % 150000").alias("user_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("event_type"), F.expr("abs(xxhash64(id, 1)) % 100000000 / 1000").alias("value"), F.lit("{}").alias("props"))
    e.write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    for name in ("approximate_statistics", "sketches_by_day"):
        assert sorted(tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()) == sorted(con.execute(catalog.SQL[name]).fetchall()), name


def test_a_quantile_outside_its_band_is_found(spark):
    tally = spark.createDataFrame([("a", 1.0, 5), ("a", 2.0, 5), ("b", 3.0, 1), ("b", 4.0, 9)], "k string, v double, n long")
    band = spark.createDataFrame([("a", 7.0, 8.0), ("b", 3.0, 4.0)], "k string, low double, high double")
    assert {r.k: r.quantile for r in sketches.exact_quantile(tally, band, ["k"], "v", 0.5).collect()} == {"a": 1.0, "b": 4.0}


def test_neighbours_are_found_by_ids_alone(spark):
    """the window that orders documents holds no words."""
    assert "lead(w" not in plan_of(catalog.QUERIES["jaccard_neighbours"](spark, SF))


def test_titles_meet_texts_on_wanted_pieces_only(spark, monkeypatch):
    """F16: where pieces are few, no others leave the tasks; where they are many, the result is the same."""
    t = spark.createDataFrame([(i, f"the act number {i} of the republic") for i in range(50)] + [(99, None)], "id long, text string")
    p = spark.createDataFrame([("number 7",), ("act",), ("zzz",)], "part string")
    wanted = spark.createDataFrame([("number",)], "piece string")
    assert contain._exploded(t, "text", [6], wanted).count() == 50
    want = sorted(map(tuple, contain.containment_join(t, "text", p, "part").collect()))
    assert len(want) == 51
    monkeypatch.setattr(contain, "BROADCAST_PIECES", 0)
    assert sorted(map(tuple, contain.containment_join(t, "text", p, "part").collect())) == want


def test_workers_hold_few_rows_at_once(spark):
    """A table that is read bounds the rows of a Python worker; slices are smaller."""
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    docs = table(spark, SF, "documents")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    import pyarrow as pa

    tokens = pa.record_batch({"doc": pa.array(range(600)), "tokens": pa.array([["a"]] * 600), "preferred": [True] * 600, "allowed": [[True]] * 600})
    assert [b.num_rows for b in lexical._counter(["a"])(iter([tokens]))] == [256, 256, 88]
    assert docs.count() > 0


def test_addresses_are_looked_for_where_there_is_an_at(spark, tmp_path):
    """odd texts, as the SQL says."""
    import duckdb

    texts = ["a@b.c+d@e.f", "x" * 3000, "@@", None, "", "a.b-c+d@e-f.gh.ij, k@l", "mail a@b.cd@e.fg", "A@B.C 1234567890", "12345678901"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = catalog.QUERIES["pii_flags"](spark, str(tmp_path))
    assert "contains" in plan_of(df).lower()
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(catalog.SQL["pii_flags"]).fetchall())


def test_stored_index_reads_documents_for_two_tables(spark):
    """with stored, no table of the index tokenises again."""
    own = lexical.build_index(table(spark, SF, "documents"), stored=True)
    for t in (own.postings, own.docs, own.terms, own.corpus):
        assert "documents.parquet" not in "".join(t.inputFiles())


def test_glossary_forms_without_case(spark):
    """a form is looked for where its letters are, whatever their case."""
    texts = ["BAIL was set", "the ſuit", "FİR filed", "firm", "জামিন", None, "Fined; a WARRANTS"]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    df = situations.glossary_hits(d, F.lit("en"))
    assert "contains" in plan_of(df).lower()
    got = {r.id: r.terms for r in df.collect()}
    assert got == {0: ["bail"], 1: ["suit"], 2: ["FIR"], 3: [], 4: ["bail"], 5: [], 6: ["fine", "warrant"]}


def test_cache_requests_are_ordered_as_columns(spark):
    """what a shard holds of its requests are Arrow columns, a few thousand at a time are objects."""
    import numpy as np
    import pyarrow as pa

    rows = pa.table({"key": ["b", "a"], "value": ["2", None]})
    assert list(state._in_order(rows, np.array([1, 0]))) == [("a", None), ("b", "2")]
