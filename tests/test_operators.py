import random

from conftest import rows
from pyspark.sql import functions as F

from evigraph.operators import contract, evaluation, evidence, ledger, resolution, speech, traces

SEG = "record string, seg_ord int, segment_id string, start double, end double, text string"


def segments(spark, texts):
    return spark.createDataFrame([("r", i, f"s{i}", float(i), i + 1.0, t) for i, t in enumerate(texts)], SEG)


def test_offsets_are_never_guessed(spark):
    s = segments(spark, ["ana ana", "bob"])
    c = spark.createDataFrame(
        [("r", "e1", "s0", "ana", 0, 3), ("r", "e2", "s0", "ana", None, None), ("r", "e3", "s1", "bob", None, None), ("r", "e4", "s1", "x", 0, 1), ("r", "e5", "s9", "bob", 0, 3), ("r", "e6", "s1", "", 0, 0), ("r", "e7", "s1", None, None, None)],
        "record string, evidence_id string, segment_id string, text string, start_char int, end_char int",
    )
    got = {r[0]: r[1:] for r in rows(evidence.recover_offsets(c, s), "evidence_id", "status", "start_char")}
    assert got == {"e1": ("already_valid", 0), "e2": ("ambiguous", None), "e3": ("recovered", 0), "e4": ("missing", None), "e5": ("unknown_segment", None), "e6": ("invalid_text", None), "e7": ("invalid_text", None)}


def test_windows(spark):
    s = segments(spark, ["a", "b", "x" * 500, "a"])
    got = rows(evidence.context_windows(s), "seg_ord", "n", "norm")
    assert got == [(0, 1, "a"), (0, 2, "a b"), (1, 1, "b")]
    assert rows(evidence.context_windows(s.limit(0))) == []


def test_nearest_after_matches_brute_force(spark):
    rng = random.Random(1)
    left = [(i, "k", float(rng.randint(0, 200))) for i in range(40)]
    right = [(f"r{i}", "k", float(rng.randint(0, 200)), rng.randint(1, 4)) for i in range(60)]
    j = evidence.nearest_after(spark.createDataFrame(left, "id int, k string, at double"), spark.createDataFrame(right, "rid string, k string, s double, size int"), ["k"], "at", "s", 7.0, "size")
    got = rows(j.groupBy("id").agg(F.min("_key").alias("m")).select("id", "m.distance"))
    want = sorted((i, min(s - at for _, _, s, _ in right if 0 <= s - at <= 7)) for i, _, at in left if any(0 <= s - at <= 7 for _, _, s, _ in right))
    assert got == want


def test_quarantine_keeps_siblings_and_order_of_rules(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (None, None)], "id int, name string")
    good, bad = contract.quarantine(df, [("id_missing", F.col("id").isNotNull()), ("name_missing", F.length("name") > 0)])
    assert rows(good) == [(1, "a")]
    assert sorted(r["issue_code"] for r in bad.collect()) == ["id_missing", "name_missing"]


def test_conflicts_and_graph(spark):
    e = spark.createDataFrame(
        [("f", "e1", "spouse", "b", "spouse", "a", "spouse", ["c1"]), ("f", "e2", "spouse", "a", "spouse", "b", "spouse", ["c2", "c1"]), ("f", "e3", "sibling", "a", "sibling", "b", "sibling", ["c3"]), ("f", "e4", "spouse", None, None, "b", None, ["c4"])],
        "family_id string, edge_id string, relationship_type string, subject_person_id string, subject_role string, object_person_id string, object_role string, source_claim_ids array<string>",
    ).withColumn("created_at", F.current_timestamp())
    assert rows(ledger.graph(e), "relationship_type", "subject", "object", "n_claims", "claims") == [("sibling", "a", "b", 1, "c3"), ("spouse", "a", "b", 2, "c1,c2")]
    assert rows(ledger.pair_conflicts(e), "first_id", "second_id", "types") == [("a", "b", "sibling,spouse")]


def test_insert_absent_is_idempotent(spark):
    a = spark.createDataFrame([("x",), ("y",)], "id string")
    b = spark.createDataFrame([("y",), ("z",), ("z",)], "id string")
    new = ledger.insert_absent(a, b, "id")
    assert rows(new) == [("z",)]
    assert rows(ledger.insert_absent(a.union(new), b, "id")) == []


def test_digest_ignores_order_and_partitions(spark):
    df = spark.createDataFrame([(i, None if i % 3 else "x") for i in range(50)], "a int, b string")
    assert rows(ledger.digest(df.repartition(7), ["a", "b"])) == rows(ledger.digest(df.orderBy(F.desc("a")).coalesce(1), ["a", "b"]))


PROFILE = "family_id string, person struct<person_id:string,canonical_name:string,aliases:array<string>,category:string,relation_to_speaker:string>, verified_aliases array<string>, generation_relative_to_speaker int"
MENTION = "mention_id string, family_id string, name string, aliases array<string>, category string, relation_to_speaker string, assertion_mode string"


def test_resolver_scenarios(spark):
    p = spark.createDataFrame(
        [("f", ("p1", "Anna", ["Anya"], "family_member", "mother"), ["Anya"], -1), ("f", ("p2", "Boris", None, "family_member", None), [], None), ("f", ("p3", "Vera", ["Shared"], "family_member", None), ["Shared"], None), ("f", ("p4", "Vika", ["Shared"], "family_member", None), ["Shared"], None)],
        PROFILE,
    )
    m = spark.createDataFrame(
        [
            ("verified", "f", "Anya", None, "family_member", None, "explicit"),
            ("exact_only", "f", "Boris", None, "family_member", None, "explicit"),
            ("with_context", "f", "Anna", None, "family_member", "mother", "explicit"),
            ("unknown", "f", "Zed", None, "family_member", None, "explicit"),
            ("shared", "f", "Shared", None, "family_member", None, "explicit"),
            ("uncertain", "f", "Anya", None, "family_member", None, "uncertain"),
            ("friend", "f", "Boris", None, "friend", None, "explicit"),
            ("blank", "f", "  ", None, None, None, None),
            ("null", "f", None, None, None, None, None),
        ],
        MENTION,
    )
    got = dict(rows(resolution.resolve(m, p), "mention_id", "status"))
    assert got == {"verified": "resolved", "exact_only": "needs_review", "with_context": "resolved", "unknown": "new_person", "shared": "needs_review", "uncertain": "needs_review", "friend": "needs_review", "blank": "new_person", "null": "new_person"}


def brute_edits(a, b):
    best = {(0, 0): (0, 0, 0, 0)}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            options = []
            if i and j:
                d, s, x, y = best[i - 1, j - 1]
                options.append((d, s, x, y) if a[i - 1] == b[j - 1] else (d + 1, s + 1, x, y))
            if i:
                d, s, x, y = best[i - 1, j]
                options.append((d + 1, s, x + 1, y))
            if j:
                d, s, x, y = best[i, j - 1]
                options.append((d + 1, s, x, y + 1))
            if options:
                best[i, j] = min(options)
    return best[len(a), len(b)]


def test_edit_counts_match_brute_force():
    rng = random.Random(0)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 7))] for _ in range(2))
        assert evaluation.edits(a, b) == brute_edits(a, b)


def test_multiset_and_empty_metrics(spark):
    a = spark.createDataFrame([("k", "x"), ("k", "x"), ("k", "y")], "k string, v string")
    e = spark.createDataFrame([("k", "x"), ("k", "z")], "k string, v string")
    assert rows(evaluation.multiset_counts(a, e, ["k"], "v")) == [("k", 1, 2, 1)]
    r = evaluation.micro(spark.createDataFrame([], "tp long, fp long, fn long")).first()
    assert (r["precision"], r["recall"], r["f1"]) == (1.0, 1.0, 1.0)


def test_smart_ranges_cap_and_gap(spark):
    s = spark.createDataFrame([("r", 0.0, 10.0), ("r", 10.5, 21.0), ("r", 21.5, 23.0), ("r", 30.0, 31.0)], "record string, start double, end double")
    assert rows(speech.smart_ranges(s, "record")) == [("r", 0, 0.0, 21.0), ("r", 1, 21.5, 23.0), ("r", 2, 30.0, 31.0)]


def test_overlapping_parts(spark):
    p = spark.createDataFrame([("r", 1, 0.0, 10.0, "one two three"), ("r", 2, 9.0, 20.0, "two three four"), ("r", 3, 20.0, 30.0, "three four five"), ("r", 4, 29.0, 31.0, "  "), ("r", 5, 29.5, 33.0, None)], "record string, index int, start double, end double, text string")
    assert rows(speech.merge_parts(p, "record")) == [("r", "one two three four three four five", 2)]


def test_traces_count_an_event_once(spark):
    e = spark.createDataFrame([("e1", "j", "s", 1, 5), ("e1", "j", "s", 1, 5), ("e2", "j", "s", 2, None)], "event_id string, job_id string, stage string, attempt int, duration_ms int")
    assert rows(traces.stage_totals(e)) == [("j", "s", 5, 2, 2)]


def test_sensitive_attributes_stay(spark):
    e = spark.createDataFrame([("e1", {"Model": "x", "API_Token": "t", "long": "y" * 300})], "event_id string, attributes map<string,string>")
    assert rows(traces.safe_attributes(e)) == [("e1", "long", "y" * 256), ("e1", "model", "x")]


def test_citations_in_transcript_order(spark):
    s = segments(spark, ["Анна пришла", "Вера ушла", "Анна ушла"])
    p = spark.createDataFrame([("r", "a", "Анна", ["s2", "zz", "s0", "s2"]), ("r", "b", "Вера", ["s2", "s1"]), ("r", "c", "Ира", ["s2", "s1"]), ("r", "d", None, ["zz"]), ("r", "e", "x", None)], "record string, m string, name string, refs array<string>")
    assert rows(evidence.ordered_segments(p, "m", "refs", s), "m", "segments") == [("a", ["s0", "s2", "zz"]), ("b", ["s1", "s2"]), ("c", ["s1", "s2"]), ("d", ["zz"])]
    assert rows(evidence.ordered_segments(p, "m", "refs", s, keep_unknown=False), "m", "segments")[-1] == ("c", ["s1", "s2"])
    assert rows(evidence.identity_segment(p, "m", "name", "refs", s), "m", "segment_id") == [("a", "s0"), ("b", "s1"), ("c", "s1")]


def test_temporal_conflicts(spark):
    e = spark.createDataFrame([("r", "1", "birth", ["a", "b"], "1950"), ("r", "2", "birth", ["b", "a"], "1951"), ("r", "2", "birth", ["b", "a"], "1951"), ("r", "3", "birth", ["a"], "1950"), ("r", "4", "birth", ["a"], "1950"), ("r", "5", "move", ["a"], "1"), ("r", "6", "move", ["a"], "2"), ("r", "7", "birth", [], "1"), ("r", "8", "birth", None, "2")], "record string, event_id string, event_type string, participants array<string>, date string")
    assert rows(ledger.temporal_conflicts(e)) == [("r", "birth", "a,b", 2, "1950,1951")]


def test_scores(spark):
    pairs = spark.createDataFrame([("m1", "a"), ("m1", "a"), ("m2", "a"), ("m2", "b"), ("m3", None)], "m string, p string")
    assert rows(evaluation.unique_keys(pairs, "m", "p")) == [("m1", "a")]
    mapped = spark.createDataFrame([("f", "a"), ("f", "a"), ("f", None), ("g", "b")], "f string, p string")
    gold = spark.createDataFrame([("f", "a"), ("f", "c"), ("h", "z"), ("g", "b")], "f string, p string")
    assert rows(evaluation.person_counts(mapped, gold, "f", "p")) == [("f", 1, 2, 1), ("g", 1, 0, 0), ("h", 0, 0, 1)]
    assert rows(evaluation.set_counts(mapped, gold, ["f"], "p")) == [("f", 1, 1, 1), ("g", 1, 0, 0), ("h", 0, 0, 1)]
    assert rows(evaluation.duplicates(mapped, "f", ["p"])) == [("f", 1), ("g", 0)]
    one = spark.createDataFrame([("k1", "x"), ("k2", None)], "k string, v string")
    two = spark.createDataFrame([("k1", "x"), ("k2", None), ("k3", "y")], "k string, v string")
    assert rows(evaluation.equal_share(one, two, "k", "v"), "n_equal", "n_expected") == [(2, 3)]
    assert rows(evaluation.equal_share(one, two.limit(0), "k", "v"), "share") == [(1.0,)]
    actual = spark.createDataFrame([("m1", "resolved", "a"), ("m2", "resolved", "b"), ("m3", "new_person", None), ("m4", "needs_review", None)], "mention_id string, status string, person_id string")
    want = spark.createDataFrame([("f", "m1", "resolved", "a"), ("f", "m2", "resolved", "a"), ("f", "m3", "resolved", "c"), ("f", "m4", "needs_review", None), ("f", "m5", "new_person", None)], "f string, mention_id string, gold_status string, gold_person string")
    assert rows(evaluation.resolution_scores(actual, want, "f"), "n_mentions", "n_right", "n_merged", "n_split") == [(5, 3, 1, 1)]
    objects = spark.createDataFrame([("f", ["a"]), ("f", ["a", "q"]), ("f", []), ("f", None), ("g", ["a"])], "f string, refs array<string>")
    known = spark.createDataFrame([("f", "a")], "f string, id string")
    assert rows(evaluation.closure(objects, "refs", known, "f")) == [("f", 4, 1), ("g", 1, 0)]
