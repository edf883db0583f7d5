"""Published vectors and the traps of the semantics."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from adjudica.functions import answers, intervals, text
from adjudica.operators import curation, fusion, pairing, ranking
from adjudica.operators.convolution import at_least, sums_of_trials
from adjudica.plans import calibration, comparison
from adjudica.sources import documents


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_level_rounds_halves_to_even_and_stays_in_range(spark):
    values = [0.5, 1.5, 2.5, -1.0, 9.0, 1.4]
    assert one(spark, *[answers.level(F.lit(v), 3).alias(str(i)) for i, v in enumerate(values)]) == (0, 2, 2, 0, 2, 1)


def credit(spark, qtype, label, value, gt, err=False, refused=False):
    typed = lambda x, t: F.lit(x).cast(t)
    return one(spark, answers.credit(F.lit(qtype), typed(label, "string"), typed(value, "double"), F.lit(gt), F.lit(err), F.lit(refused)))[0]


def test_credit(spark):
    assert credit(spark, "score", None, 1.4, "2") == 0.5
    assert credit(spark, "score", None, 2.6, "2") == 1.0
    assert credit(spark, "score", None, 0.0, "2") == 0.0
    assert credit(spark, "noul", None, 0.5, "1") == 1.0
    assert credit(spark, "choice", "a", None, "b") == 0.0
    assert credit(spark, "choice", "b", None, "b", refused=True) == 0.0
    assert credit(spark, "choice", "b", None, "b", err=True) is None


def test_first_best_takes_the_first_of_equals(spark):
    rows = spark.createDataFrame([(0, "a", 5), (1, "b", 7), (2, "c", 7)], "ord int, opt string, w int")
    assert rows.agg(answers.first_best(F.col("w"), F.col("ord"), F.col("opt"))).first()[0] == "b"


def test_mcnemar(spark):
    rows = spark.createDataFrame([(6, 0), (0, 0), (3, 5), (1500, 1400)], "b long, c long")
    found = [r[0] for r in rows.select(intervals.mcnemar_p("b", "c")).collect()]
    assert found[0] == pytest.approx(0.03125)
    assert found[1] == 1.0
    assert found[2] == pytest.approx(2 * sum(math.comb(8, i) for i in range(4)) / 2**8)
    assert found[3] == pytest.approx(2 * sum(math.comb(2900, i) for i in range(1401)) / 2**2900)


def test_clopper_pearson(spark):
    rows = spark.createDataFrame([(48, 100), (0, 10), (10, 10), (0, 0)], "k long, n long")
    found = [(r[0], r[1]) for r in rows.select(intervals.clopper_pearson("k", "n").alias("c")).select("c.*").collect()]
    assert found[0] == pytest.approx((0.3790, 0.5822), abs=1e-4)
    assert found[1] == pytest.approx((0, 0.3085), abs=1e-4)
    assert found[2] == pytest.approx((0.6915, 1), abs=1e-4)
    assert found[3] == (None, None)


def test_poisson_binomial(spark):
    groups = {"a": ([0.5] * 3, 2), "b": ([0.5] * 3, 0), "c": ([0.2, 0.5, 0.7], 2), "d": ([0.0] * 4 + [1.0] * 2, 2), None: ([0.25, None, 0.5], 3)}
    trials = spark.createDataFrame([(g, p) for g, (ps, _) in groups.items() for p in ps], "g string, p double")
    asked = spark.createDataFrame([(g, k) for g, (_, k) in groups.items()], "h string, k long")
    sums = sums_of_trials(trials, ["g"], "p").join(asked, F.col("g").eqNullSafe(F.col("h")))
    found = {r["g"]: r["sf"] for r in sums.select("g", at_least(F.col("low"), F.col("mass"), F.col("k")).alias("sf")).collect()}
    brute = sum(math.prod(p if hit else 1 - p for p, hit in zip((0.2, 0.5, 0.7), hits, strict=True)) for hits in itertools.product((0, 1), repeat=3) if sum(hits) >= 2)
    assert [found[g] for g in groups] == pytest.approx([0.5, 1.0, brute, 1.0, 0.0])


def test_poisson_binomial_of_many_trials(spark):
    trials = spark.range(40_000).select(F.lit(1).alias("g"), (F.col("id") % 997 / 1000).alias("p"))
    row = sums_of_trials(trials, ["g"], "p").first()
    ps = np.array([k % 997 / 1000 for k in range(40_000)])
    mean, spread = ps.sum(), math.sqrt((ps * (1 - ps)).sum())
    mass = np.array(row["mass"])
    assert len(mass) < 30 * spread and mass.sum() == pytest.approx(1)  # as wide as its spread, not as its trials
    assert (mass * (row["low"] + np.arange(len(mass)))).sum() == pytest.approx(mean)
    exact = np.ones(1)
    for p, n in zip(*np.unique(ps, return_counts=True), strict=True):
        one = np.ones(1)
        for _ in range(n):
            one = np.convolve(one, [1 - p, p])
        exact = np.fft.irfft(np.fft.rfft(exact, 1 << 16) * np.fft.rfft(one, 1 << 16), 1 << 16)
    assert np.abs(mass - exact[row["low"] : row["low"] + len(mass)]).max() < 1e-12


def test_bank_with_a_gap_is_refused(spark):
    bank = spark.createDataFrame([(1, "a", "u v w".split()), (2, "b", "x y".split()), (3, "b", "k".split())], "key int, phase string, words array<string>")
    index = spark.createDataFrame([("u v", 1), ("v w", 1), ("x y", 2)], "gram string, first_key int")
    assert curation.covered_index(bank, index, "key", "phase", ["a", "b"], n=2).count() == 3
    with pytest.raises(curation.BankError, match="no texts of c"):
        curation.covered_index(bank, index, "key", "phase", ["a", "b", "c"], n=2)
    with pytest.raises(curation.BankError, match="lacks grams of 2"):
        curation.covered_index(bank, index.where("gram <> 'x y'"), "key", "phase", ["a", "b"], n=2)
    with pytest.raises(curation.BankError, match="no grams"):
        curation.covered_index(bank, index.limit(0), "key", "phase", ["a"], n=2)


def test_index_digest_sees_every_change(spark):
    rows = [(f"g{k}", k % 7) for k in range(500)]
    digest = lambda r: tuple(curation.index_digest(spark.createDataFrame(r, "gram string, first_key long")).first())
    assert digest(rows) == digest(rows[::-1]) and digest(rows)[0] == 500
    assert len({digest(rows), digest(rows[1:]), digest([("g0", 1), *rows[1:]]), digest([("G0", 0), *rows[1:]])}) == 4


def test_newcombe(spark):
    table = lambda *x: one(spark, *intervals.newcombe(*[F.lit(v) for v in x]))
    delta, low, _ = table(40, 5, 15, 40)
    assert delta == pytest.approx(-0.10) and low < -0.1
    delta, low, high = table(40, 10, 10, 40)
    assert delta == 0 and low < 0 < high


def test_kappa(spark):
    rows = spark.createDataFrame([("0", "0"), ("1", "1"), ("0", "1"), ("1", "1")], "a string, b string").withColumn("g", F.lit(1))
    assert pairing.kappa(rows, ["g"], "a", "b").first()["kappa"] == pytest.approx(0.5)
    renamed = rows.replace({"0": "z", "1": "b"})
    assert pairing.kappa(renamed, ["g"], "a", "b").first()["kappa"] == pytest.approx(0.5)
    alone = spark.createDataFrame([(1, "x", "x")], "g int, a string, b string")
    assert pairing.kappa(alone, ["g"], "a", "b").first()["kappa"] is None


def test_holm_keeps_missing_tests(spark):
    tests = spark.createDataFrame([(1, "a", 0.01), (1, "b", None), (1, "c", 0.02)], "f int, t string, p double")
    found = {r["t"]: r["p_holm"] for r in ranking.holm(tests, ["f"], "p", ["t"]).collect()}
    assert found == pytest.approx({"a": 0.03, "c": 0.04, "b": 1.0})


def test_order_statistics_and_ranks(spark):
    values = [5, 1, 5, 3, 3, 3, 9]
    rows = spark.createDataFrame([(1, v) for v in values], "g int, v int")
    found = ranking.order_statistics(rows, ["g"], "v", {"mid": F.floor(F.col("n") / 2), "out": F.col("n")}).first()
    assert (found["n"], found["mid"], found["out"]) == (7, sorted(values)[3], None)
    ranks = sorted((r["v"], r["r"]) for r in ranking.average_ranks(rows, ["g"], "v", "r").collect())
    assert ranks == [(1, 1.0), (3, 3.0), (3, 3.0), (3, 3.0), (5, 5.5), (5, 5.5), (9, 7.0)]


def test_calibration_bins(spark):
    edges = [k / 10000 for k in range(0, 10001, 7)]
    rows = spark.createDataFrame([(x,) for x in edges], "c double")
    found = {r[0]: r[1] for r in rows.select("c", calibration.bin_of(F.col("c"))).collect()}
    for x in edges:
        assert found[x] == next(b for b in range(10) if (b / 10 < x or (b == 0 and x == 0)) and x <= (b + 1) / 10 + 1e-12)


def test_leave_one_out_against_loops(spark):
    rng = random.Random(3)
    cases = [(0, i, rng.randrange(12) / 4, rng.choice(["skip", "abstract", "full"]), rng.choice(["abstract", "full"])) for i in range(40)]
    decide = lambda c, t: "skip" if c[2] < t else c[4]

    def best(rest):
        values = sorted(c[2] for c in rest)
        found, most = 0.0, -1
        for t in [0.0, *((a + b) / 2 for a, b in zip(values, values[1:], strict=False)), 2.0]:
            ok = sum(decide(c, t) == c[3] for c in rest)
            if ok > most:
                found, most = t, ok
        return found

    made = [decide(c, best([x for x in cases if x is not c])) for c in cases]
    wanted = (sum(m == c[3] for m, c in zip(made, cases, strict=True)), sum(m == "skip" == c[3] for m, c in zip(made, cases, strict=True)))
    rows = spark.createDataFrame(cases, "run int, case_id long, rel double, truth string, deep string")
    found = comparison.leave_one_out(rows).first()
    assert (found["loo"], found["skip_recall"]) == wanted


def test_fallback_only_where_it_helps(spark):
    value = lambda a, b: one(spark, fusion.fallback(F.lit(a), F.lit(b), F.lit("a"), F.lit("b")))[0]
    assert [value(True, False), value(True, True), value(False, False)] == ["b", "a", "a"]


@pytest.mark.parametrize(("raw", "wanted"), [("Ça—va, Straße İx ﬁn", "ca va stra e ix n"), ("  ", ""), (None, None), ("Ünïcödé é", "unicode e")])
def test_normalised(spark, raw, wanted):
    assert one(spark, text.normalised(F.lit(raw).cast("string")))[0] == wanted


def test_grams(spark):
    words = lambda n: F.array(*[F.lit(f"w{i}") for i in range(n)])
    assert one(spark, text.grams(words(7)))[0] == []
    assert one(spark, text.grams(words(9)))[0] == [" ".join(f"w{i}" for i in range(k, k + 8)) for k in (0, 1)]


def test_hex_modulo(spark):
    digests = [f"{random.Random(i).getrandbits(256):064x}" for i in range(50)]
    rows = spark.createDataFrame([(d,) for d in digests], "d string")
    assert {r[0]: r[1] for r in rows.select("d", text.hex_modulo_10(F.col("d"))).collect()} == {d: int(d, 16) % 10 for d in digests}


def test_copies_of_contaminated_texts_are_ngram_hits(spark):
    long = "one two three four five six seven eight nine"
    bank = spark.createDataFrame([(1, long)], "item_id long, text string")
    texts = spark.createDataFrame([(1, long + " a"), (2, long + " a"), (3, "clean text"), (4, "Clean, TEXT!"), (5, None), (6, "kept out")], "doc_id long, text string")
    found = curation.filter_reasons(texts, "doc_id", "text", curation.gram_index(bank, "item_id", "text"), F.col("doc_id") == 6)
    assert {r[0]: r[1] for r in found.collect()} == {1: "ngram", 2: "ngram", 3: "kept", 4: "duplicate", 5: "kept", 6: "key"}
    with pytest.raises(ValueError, match="empty"):
        curation.gram_hits(texts, "doc_id", "text", curation.gram_index(bank.limit(0), "item_id", "text"))


def test_result_documents(spark, tmp_path):
    (tmp_path / "run_a").mkdir()
    (tmp_path / "run_a" / "ood.json").write_text('{"meta": {"model": "m"}, "cases": {"c1": {"answers": {"q": {"type": "noul", "noul": 0.25}, "r": {"type": "refusal"}}, "ms": 5}, "c2": {"error": "HTTP error 500", "ms": 7}}}')
    records = documents.read_results(spark, str(tmp_path / "*" / "*.json"))
    assert sorted((r["run"], r["phase"], r["case_id"], r["error"]) for r in records.collect()) == [("run_a", "ood", "c1", None), ("run_a", "ood", "c2", "HTTP error 500")]
    flat = documents.flatten_answers(records, ["run", "case_id"])
    assert sorted((r["qid"], r["refused"], r["value"]) for r in flat.collect()) == [("q", False, 0.25), ("r", True, None)]
    documents.write_results(records, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_stream_totals_equal_batch_totals(spark, small, tmp_path):
    from adjudica.streaming import totals

    events = spark.read.parquet(f"{small}/events.parquet")
    (tmp_path / "in").mkdir()
    last = events.orderBy(F.desc("ts")).limit(1).withColumn("ts", F.expr("ts + INTERVAL 30 DAYS"))
    events.write.parquet(str(tmp_path / "in" / "a"))
    last.write.parquet(str(tmp_path / "in" / "b"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = totals.start_hourly(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    query.awaitTermination(120)
    rows = lambda df: sorted(map(tuple, df.select("event_type", F.col("hour").cast("string"), "n").collect()))
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(totals.hourly(events))


def test_files(spark, tmp_path):
    from adjudica.sources import files

    rows = spark.createDataFrame([(1, "a"), (2, None)], "id long, text string")
    files.write_jsonl(rows, str(tmp_path / "lines"))
    part = next((tmp_path / "lines").glob("part*"))
    part.write_text(part.read_text() + "\n\n")
    (tmp_path / "lines" / f".{part.name}.crc").unlink(missing_ok=True)
    assert sorted(map(tuple, files.read_jsonl(spark, str(tmp_path / "lines"), "id long, text string").collect()), key=str) == [(1, "a"), (2, None)]
    hashes = files.file_hashes(spark, str(part)).first()
    import hashlib

    assert hashes["sha256"] == hashlib.sha256(part.read_bytes()).hexdigest()
    table = files.markdown_table(spark.createDataFrame([("a", 0.5), ("b", None)], "k string, v double"))
    assert table.splitlines() == ["| k | v |", "| --- | --- |", "| a | 0.500 |", "| b | — |"]
    page = "x <!-- AUTO:t -->old<!-- /AUTO:t --> y"
    once = files.replace_section(page, "t", table)
    assert once.startswith("x ") and once.endswith(" y") and files.replace_section(once, "t", table) == once
    with pytest.raises(ValueError, match="no section"):
        files.replace_section(page, "u", "")
    with pytest.raises(ValueError, match="at most"):
        files.markdown_table(rows, limit=1)


def test_newcombe_without_pairs(spark):
    from adjudica.functions.intervals import newcombe

    rows = spark.createDataFrame([(0, 0, 0, 0), (40, 5, 15, 40)], "a long, b long, c long, d long")
    found = rows.select(*[x.alias(n) for n, x in zip(("delta", "low", "high"), newcombe(*(F.col(x) for x in "abcd")), strict=True)]).collect()
    assert found[0]["delta"] == 0 and math.isnan(found[0]["low"]) and math.isnan(found[0]["high"])
    assert found[1]["delta"] == pytest.approx(-0.10) and found[1]["low"] < -0.1


def test_exact_tails_against_sums():
    import numpy as np

    from adjudica.functions.intervals import at_least, lower_limit

    for n in (1, 7, 60):
        for p in (0.01, 0.3, 0.5, 0.97):
            k = np.arange(0, n + 2)
            wanted = [sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(x, n + 1)) for x in k]
            assert at_least(k, np.full(len(k), n), np.full(len(k), p)) == pytest.approx(wanted, abs=1e-12)
    k = np.array([0, 1, 48, 99, 100, 50_000])
    n = np.array([10, 10, 100, 100, 100, 100_000])
    low = lower_limit(k, n, 0.025)
    assert low[0] == 0 and at_least(k[1:], n[1:], low[1:]) == pytest.approx(0.025, rel=1e-6)


def test_first_wins_keeps_null_texts(spark):
    from adjudica.operators.curation import first_wins

    rows = spark.createDataFrame([(1, None), (2, "a"), (3, None), (4, "a"), (5, "b")], "id long, text string")
    found = {r["id"]: (r["first"], r["kept"]) for r in first_wins(rows, "id", F.col("text")).collect()}
    assert found == {1: (1, True), 2: (2, True), 3: (1, False), 4: (2, False), 5: (5, True)}


def test_index_digest_sees_grams_and_keys(spark):
    from adjudica.operators.curation import index_digest

    digest = lambda rows: index_digest(spark.createDataFrame(rows, "gram string, first_key long")).first()["digest"]
    base = digest([("a b", 1), ("c d", 2)])
    assert base == digest([("c d", 2), ("a b", 1)]) and len({base, digest([("a b", 1), ("c d", 3)]), digest([("a b", 1), ("c e", 2)])}) == 3


def test_redaction_inside_texts(spark):
    from adjudica.functions.redaction import redacted

    rows = spark.createDataFrame([('{"a":[{"Secret":1}],"t":"{\\"my_key\\":2}"}',), ("no json",), (None,), ('{"a":1}',)], "j string")
    assert [r[0] for r in rows.select(redacted("j")).collect()] == ['{"a":[{"Secret":"<redacted>"}],"t":"{\\"my_key\\":\\"<redacted>\\"}"}', "no json", None, '{"a":1}']


def test_a_missing_source_stops(spark):
    from adjudica.plans.studies import require_sources

    rows = spark.createDataFrame([("a",), ("b",)], "source string")
    assert require_sources(rows, ["a"]).count() == 2
    with pytest.raises(ValueError, match="no rows of c"):
        require_sources(rows, ["a", "c"])


@pytest.mark.parametrize("size", [1, 9, 10, 25, 31])
def test_spread_places(spark, size):
    """Places without a sort of the group: those of positions ordered by (position modulo step, position)."""
    from adjudica.operators.curation import spread_order

    rows = spark.range(size).select((F.col("id") * 3 + 5).alias("id"), F.lit("s").alias("source"))
    found = {r["pos"]: r["place"] for r in spread_order(rows, "source", "id", 10).collect()}
    step = max(1, size // 10)
    assert found == {p: k + 1 for k, p in enumerate(sorted(range(size), key=lambda p: (p % step, p)))}


def test_chains_of_any_length(spark):
    from adjudica.plans.state import chain_ends

    edges = [(k, k + 1) for k in range(100)] + [(500, 501)]
    found = {r["start"]: (r["last"], r["hops"]) for r in chain_ends(spark.createDataFrame(edges, "start long, last long")).collect()}
    assert found == {**{k: (100, 100 - k) for k in range(100)}, 500: (501, 1)}


def test_resume_goes_on_where_the_sink_ends(spark, tmp_path):
    from adjudica.plans.checks import resume

    sink, work = f"file://{tmp_path}/sink", lambda rows: rows.withColumn("made", F.col("id") * 2)
    done = [resume(spark.range(10), sink, "id", work, most=4) for _ in range(4)]
    assert done == [4, 4, 2, 0]
    assert sorted((r["id"], r["made"]) for r in spark.read.parquet(sink).collect()) == [(k, 2 * k) for k in range(10)]
