"""Re-scans, queues, folds and recalled memories against plain Python."""

import random
import resource

from pyspark.sql import functions as F

from weftline import catalog
from weftline.operators import fold, frontier, memory, stream

MANIFEST = "sample_id string, source_ref string, stream_position long, title string, text string"


def test_rescan_tries_each_pair_once(spark):
    rng = random.Random(4)
    words = ["red", "blue sky", "Green", "old  man", "sea"]
    rows = [(s, f"{s}{k}", k, rng.choice(["Sea", "Other"]), " and ".join(rng.sample(words, rng.randrange(4)))) for s in "ab" for k in range(40)]
    m = spark.createDataFrame(rows, MANIFEST)
    edges = [(s, e, a) for s in "ab" for e, a in ((1, "RED"), (1, "blue   sky"), (2, "green"), (3, "old man"), (4, "sea"))]
    df = spark.createDataFrame(edges, "sample_id string, edge_id long, anchor string")
    fold_ = lambda s: " ".join(s.lower().split())
    meets = lambda a, r: fold_(a) in fold_(r[4]) or fold_(a) == fold_(r[3])
    active = {1: {1}, 2: {1, 2, 4}, 3: {2, 3, 4}, 4: {1, 2, 3, 4}, 5: {1, 2, 3, 4}}
    cursor = {1: 10, 2: 20, 3: 20, 4: 39, 5: 39}
    for requests in (None, 2):
        scan, tried, edges_seen, pool, last = frontier.begin_scan(m, df), {}, set(), set(), -1
        for r in range(1, 6):
            now = [e for e in edges if e[1] in active[r]]
            scan = frontier.rescan(scan, m, df.where(F.col("edge_id").isin(*active[r])), m.select("sample_id").distinct().withColumn("cursor", F.lit(cursor[r])), 3, requests)
            pool |= {(e[0], e[1], x[1], x[2]) for e in now for x in rows if x[0] == e[0] and x[2] <= cursor[r] and (e not in edges_seen or x[2] > last) and meets(e[2], x)} - set(tried)
            edges_seen |= set(now)
            last = cursor[r]
            for s in "ab":
                able = sorted({p[1] for p in pool if p[0] == s and p[1] in active[r]})[:requests]
                for e in able:
                    for p in sorted((p for p in pool if p[:2] == (s, e)), key=lambda p: p[3])[:3]:
                        tried[p] = r
                        pool.discard(p)
        got = [((t.sample_id, t.edge_id, t.source_ref, t.stream_position), t.round) for t in scan.tried.collect()]
        assert len(got) == len(dict(got)) and dict(got) == tried
        assert {(w.sample_id, w.edge_id, w.source_ref, w.stream_position) for w in scan.waiting.collect()} == pool


def test_titles_and_spaces_in_mentions(spark):
    m = spark.createDataFrame([("s", "r1", 0, "The  Sea", "nothing here"), ("s", "r2", 1, "x", "by the\n SEA side"), ("s", "r3", 2, None, None)], MANIFEST)
    got = stream.mention_search(m, spark.createDataFrame([("the sea",), (" ",), (None,), ("ide",)], "phrase string"), 5).collect()
    assert sorted((r.phrase, r.source_ref, r.place) for r in got) == [("ide", "r2", 1), ("the sea", "r1", 1), ("the sea", "r2", 2)]
    assert stream.mention_search(m.drop("title"), spark.createDataFrame([("the sea",)], "phrase string"), 5).count() == 1


def test_mentions_by_task_are_those_by_join(spark, monkeypatch):
    """Both ways, with a limit and without, against brute force; a repeated row counts each time."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abÉ𝄞", k=rng.randint(1, 5)))
    lines = [(rng.choice(["s", "T  u", None]), f"r{i}", rng.choice([None, "A b", "ab"]), rng.choice([None, "", " ".join(word() for _ in range(9)), word() * 20])) for i in range(150)]
    lines = [(s, r, i // 2, t, x) for i, (s, r, t, x) in enumerate(lines)] + [("s", "twice", 9, "ab", "ab a\tb")] * 2
    phrases = sorted({" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(300)}) + ["ab", "A  B", " "]
    m, asked = spark.createDataFrame(lines, MANIFEST).repartition(3), spark.createDataFrame([(p,) for p in phrases], "phrase string")
    low = lambda x: " ".join((x or "").lower().split())
    want = sorted((p, r) for p in {low(p) for p in phrases} - {""} for _, r, _, t, x in lines if p in low(x) or p == low(t))
    firsts = {}
    for limit, most in ((None, stream.MOST_ASKED), (3, stream.MOST_ASKED), (3, -1), (None, -1)):
        monkeypatch.setattr(stream, "MOST_ASKED", most)
        if limit is None:
            assert sorted((h.phrase, h.source_ref) for h in stream.mention_hits(m, asked).collect()) == want
        else:
            firsts[most] = sorted((h.phrase, h.source_ref, h.place) for h in stream.mention_search(m, asked, limit, ["sample_id", "stream_position", "source_ref"]).collect())
    key = {r: (s is not None, s, p, r) for s, r, p, _, _ in lines}
    by_phrase = {p: sorted((key[r], r) for q, r in want if q == p) for p in {p for p, _ in want}}
    assert firsts[-1] == sorted((p, r, n + 1) for p, hits in by_phrase.items() for n, (_, r) in enumerate(hits[:3]))
    assert all(f == firsts[-1] for f in firsts.values()) and len(firsts) == 2


def test_what_a_task_forgets_changes_no_mention(monkeypatch):
    monkeypatch.setattr(stream, "MOST_WORDS", 3)
    monkeypatch.setattr(stream, "MOST_KEPT", 7)
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abc", k=rng.randint(1, 4)))
    phrases = {" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(60)}
    texts = [" ".join(word() for _ in range(rng.randint(1, 8))) for _ in range(200)]
    for asked in (phrases, {p for p in phrases if " " in p}, {p for p in phrases if " " not in p}):
        find = stream._finder(asked)
        assert all(find(t) == {p for p in asked if p in t} for t in texts)
    hits = [(p, (n,), (n,)) for n in rng.sample(range(300), 300) for p in "xyz" if n % 3 or p == "x"]
    kept = list(stream._firsts(hits, 4))
    assert len(kept) < len(hits)
    for p in "xyz":
        assert sorted(k for q, k, _ in kept if q == p)[:4] == sorted(k for q, k, _ in hits if q == p)[:4]


def test_titles_search_shuffles_less_than_its_texts(spark, tmp_path):
    rng = random.Random(3)
    docs = [(d, "\n".join(" ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(12)) for _ in range(20)), f"src{d % 4}") for d in range(400)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, f"{c} x") for i, c in enumerate("abcd")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = written()
    got = catalog.QUERIES["mention_titles"](spark, str(tmp_path)).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert written() - before < sum(len(t) for _, t, _ in docs) / 10
    assert sorted((r.phrase, r.place) for r in got) == sorted((p, n) for p in [*"abcd", *(f"src{k}" for k in range(4))] for n in range(1, 5))


def test_admission_passes_over_what_does_not_fit(spark):
    queue = [("r", "a", 1, 3), ("r", "b", 2, 5), ("r", "a", 3, 1), ("r", "c", 4, 2), ("r", "d", 5, 1), ("r", "e", 6, 1), ("q", "a", 1, 9), ("z", "a", 1, 1)]
    got = frontier.admit(spark.createDataFrame(queue, "run_id string, claim_id string, place int, calls int"), spark.createDataFrame([("r", 6, 3), ("q", 5, 5)], "run_id string, most_calls int, most_claims int")).collect()
    assert sorted((r.run_id, r.claim_id, r.decision, r.calls_used) for r in got) == [("q", "a", "MAX_MODEL_CALLS", 0), ("r", "a", "ADMITTED", 3), ("r", "b", "MAX_MODEL_CALLS", 3), ("r", "c", "ADMITTED", 5), ("r", "d", "ADMITTED", 6), ("r", "e", "MAX_CLAIMS", 6)]


def test_a_long_key_folds_in_flat_memory(spark):
    """One key of 100,000 rows of a kilobyte: the worker holds no more than a small share of the 100 MB."""
    rows = spark.range(100_000).select(F.lit("k").alias("key"), F.col("id").alias("at"), F.repeat(F.lit("x y "), 250).alias("text"))

    def step(state, row):
        state["n"] += 1
        state["sum"] = (state["sum"] * 31 + row["at"]) % 1_000_003
        return state, []

    begin = lambda key: {"n": 0, "sum": 0, "least": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss}
    end = lambda s: [(s["n"], s["sum"], resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - s["least"])]
    n, total, grown_kb = fold.ordered_fold(rows, ["key"], ["at"], begin, step, "n long, sum long, kb long", end).first()
    want = 0
    for k in range(100_000):
        want = (want * 31 + k) % 1_000_003
    assert (n, total) == (100_000, want) and grown_kb < 60_000


def test_memory_is_recalled(spark):
    chunks = [("q1", k, c) for k, c in enumerate(["apple pie", "blue car", None, "apple tart"])] + [("q2", 0, "solo")]

    def respond(key, chunk, seen, recalled):
        if chunk is None:
            return f"end {seen}|{recalled}"
        return f"{chunk} noted <recall>{chunk}</recall>" if chunk else "blank"

    got = memory.memory_fold(spark.createDataFrame(chunks, "q string, k int, c string"), "q", "k", "c", respond, keep=2).orderBy("q", "step").collect()
    first = [r for r in got if r.q == "q1"]
    assert [r.final for r in first] == [False] * 4 + [True]
    assert [r.memory for r in first] == ["No previous memory", "apple pie noted", "blue car noted", "blank", "apple tart noted"]
    # the fourth turn asks for "apple tart"; "apple pie" fell out when the third memory came, so only the blue car and the blank are held
    assert [r.recalled for r in first] == ["No memory was recalled."] * 5
    kept = memory.memory_fold(spark.createDataFrame(chunks, "q string, k int, c string"), "q", "k", "c", respond).where("q = 'q1' and final").first()
    assert kept.recalled == "apple pie noted" and kept.response == "end apple tart noted|apple pie noted"
    assert [r.step for r in got if r.q == "q2"] == [0, 1]
    assert memory.chunk_words(spark.createDataFrame([("a", "1 2  3 4 5"), ("b", ""), ("c", None)], "q string, t string"), "q", "t", 2).where("q = 'a'").orderBy("order").collect()[2].chunk == "5"


def test_recall_is_the_nearest_earlier_memory(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(18)]
    said = [(r, s, " ".join(rng.choice(words) for _ in range(rng.randrange(12)))) for r in range(3) for s in range(30)]
    asked = [(r, s, " ".join(rng.choice(words) for _ in range(rng.randrange(9)))) for r in range(4) for s in range(0, 30, 2)]
    for least in (0.2, 0.5, 1.0):
        want = {}
        for r, s, q in asked:
            a = set(q.split())
            scored = [(len(a & b) / len(a | b), -t) for rr, t, m in said if rr == r and t < s and (b := set(m.split())) and a]
            if scored and max(scored)[0] >= least - 1e-12:
                want[r, s] = (-max(scored)[1], round(max(scored)[0], 9))
        got = memory.recall_earlier(spark.createDataFrame(said, "run_id long, step long, text string"), spark.createDataFrame(asked, "run_id long, step long, query string"), least).collect()
        assert {(g.run_id, g.step): (g.found, round(g.score, 9)) for g in got} == want
