import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from utterlake.functions import spoken
from utterlake.functions import text as T
from utterlake.functions import waves as W
from utterlake.operators import corpus as C
from utterlake.operators import scoring
from utterlake import runtime
from utterlake.runtime import numbered


def one(spark, value, f, type_="string"):
    return spark.createDataFrame([(value,)], f"x {type_}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("text", "want"), [("", "en"), ("a अ", "en"), ("abc१", "en"), ("नमस्ते", "hi"), ("தமிழ் தமிழ்", "en"), ("ಕನ್ನಡ", "kn"), ("বাংলা", "bn")])
def test_script(spark, text, want):
    assert one(spark, text, T.script) == want


@pytest.mark.parametrize(("text", "lang", "want"), [
    ("ISRO100 R&D AB&c A& x ÜBER", "none", "I S R O 1 0 0 R and D A B and c A and x ÜBER"), ("$1 ₹500 £0.5 $1,500", "en", "1 dollar 500 rupees 0.5 pound 1 dollar,500"), ("₹५", "en", "५ rupees"),
    ("100% R&D a/b", "en", "100 percent R and D a slash b"), ("100% R&D a/b", "hi", "100 pratishat R aur D a bata b"), ("₹500", "hi", "500 rupaye"),
])
def test_normalise(spark, text, lang, want):
    assert one(spark, text, lambda x: T.normalise(x, lang)) == want


def test_clean_takes_unicode_blanks(spark):
    assert one(spark, " a \u0085b\x1cc​d ", T.clean) == "a b c​d"


def test_sentences_and_chunks(spark):
    assert one(spark, "नमस्ते दुनिया।। यह है! ok", T.sentences) == ["नमस्ते दुनिया।।", "यह है!", "ok"]
    parts = ["a" * 200, "b" * 160, "c"]
    assert one(spark, parts, T.chunks, "array<string>") == [parts[0] + " " + parts[1], "c"]
    assert one(spark, ["d" * 1000], T.chunks, "array<string>") == ["d" * 1000]
    assert one(spark, [], T.chunks, "array<string>") == []


def test_tokens_round_trip(spark):
    assert one(spark, [3, 1, 2], lambda x: T.parse_tokens(T.render_tokens(x, "global"), "global"), "array<int>") == [3, 1, 2]


def test_waves(spark):
    nan = float("nan")
    assert one(spark, [nan, float("inf"), 0.5], W.finite, "array<double>") == [0.0, 0.0, 0.5]
    assert one(spark, [0.0] * 10 + [0.5] + [0.0] * 10, lambda x: W.trim(x, 100), "array<double>") == [0.0] * 5 + [0.5] + [0.0] * 5
    assert one(spark, [0.5, -0.5], lambda x: W.prepare(x, 100), "array<double>") == [0.5, -0.5]
    assert [one(spark, x, W.silent, "array<double>") for x in (None, [], [nan], [0.0], [0.5])] == [True, True, True, True, False]
    assert max(one(spark, [0.0001, -0.0001], W.lift, "array<double>")) == pytest.approx(0.003)


def test_training_rows_at_the_limits(spark):
    rows = spark.createDataFrame([(1, [7], [1, 2, 3, 4])], "vec_id long, global_ids array<int>, semantic_ids array<int>")
    ids = lambda most: [r.input_ids for r in C.training_rows(rows, F.array(F.lit(5)), most).collect()]
    assert ids(5) == [] and ids(7) == [] and ids(8)[0][-3:] == [1, C.END_SEMANTIC, C.IM_END]
    r = C.training_rows(rows, F.array(F.lit(5)), 50).first()
    assert len(r.labels) == len(r.input_ids) == len(r.attention_mask) and r.labels[:5] == [-100] * 5
    assert C.legacy_training_rows(rows, F.array(*[F.lit(5)] * 4), 3).first().labels == [-100] * 3


def test_split_and_caps(spark):
    rows = spark.range(125).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"))
    assert C.split_validation(rows, 0.02).where("is_val").count() == 2
    assert C.split_validation(rows.limit(1), 0.02).where("is_val").count() == 0
    assert C.split_validation(rows.limit(2), 0.02).where("is_val").count() == 1
    assert C.balanced(rows, ["en"], 0.5).count() == C.balanced(rows, ["en"], 1.0).count() == 125
    assert C.capped(rows, "lang", 7).count() == 7


def test_references(spark):
    rows = spark.createDataFrame([("a", "s"), ("b", "t"), ("c", "t"), ("d", None)], "audio_path string, speaker string")
    got = {r.audio_path: r.ref for r in C.references(rows, chance="1.1").collect()}
    assert got == {"a": "a", "b": "c", "c": "b", "d": "d"}


def test_references_keep_every_row(spark):
    rows = spark.createDataFrame([("a", "s"), ("a", "s"), ("b", "s"), (None, "s"), ("a", "s"), ("x", ""), ("x", "")], "audio_path string, speaker string")
    got = sorted(((r.audio_path, r.speaker, r.ref) for r in C.references(rows, chance="1.1").collect()), key=str)
    assert [g[:2] for g in got] == sorted([(r.audio_path, r.speaker) for r in rows.collect()], key=str)
    assert {g[2] for g in got if g[0] == "a"} <= {"a", "b"} and [g for g in got if g[0] == "x"] == [("x", "", "x")] * 2
    assert C.references(rows, chance="1.1", pool_limit=1).count() == 7 and C.references(rows.limit(0)).collect() == []


def test_crossfade(spark):
    rows = spark.createDataFrame([(0, 0, [1.0] * 4), (0, 1, []), (0, 2, [1.0] * 4), (1, 0, [0.5])], "g int, o int, w array<double>")
    got = {(r.g, r.pos): r["sample"] for r in C.crossfaded(rows, "g", "o", "w", 2).collect()}
    assert got == {**{(0, p): pytest.approx(1.0) for p in range(6)}, (1, 0): 0.5}


def test_places_in_groups_over_many_tasks(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 2 == 0, F.concat(F.lit("g"), F.col("id") % 50)).alias("g")).repartition(5)
        got = numbered(rows, ["g"], [F.md5(F.col("id").cast("string"))], "at").collect()
        whole = numbered(rows, [], [-F.col("id")], "at").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    groups = {}
    for r in rows.collect():
        groups.setdefault(r.g, []).append((hashlib.md5(str(r.id).encode()).hexdigest(), r.id))
    assert {(r.g, r.at, r.id) for r in got} == {(g, i, x) for g, v in groups.items() for i, (_, x) in enumerate(sorted(v))}
    assert len(got) == len(whole) == 3000 and all(r.at == 2999 - r.id for r in whole)
    assert numbered(rows.limit(0), ["g"], ["id"], "at").collect() == []


@pytest.mark.parametrize("n", [0, 1, 2, 7, 8, 40])
def test_ranges_hold_what_lies_between_their_cuts(spark, n):
    cuts = sorted(random.Random(n).sample(range(-50, 50), n))
    keys = [None, *range(-55, 55)]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", runtime.bucket_of(F.col("k"), cuts).alias("b")).collect()
    assert {r.k: r.b for r in got} == {k: 0 if k is None else sum(c < k for c in cuts) for k in keys}


def test_large_files_are_sorted_in_more_tasks(spark, tmp_path, monkeypatch):
    spark.range(20_000).selectExpr("id", "sha2(cast(id as string), 256) AS text").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).where("id >= 0")
    session = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert runtime.tasks_for(df) == session and runtime.tasks_for(spark.createDataFrame([(1,)], "x long")) == session
    monkeypatch.setattr(runtime, "TASK_BYTES", 10_000)
    assert runtime.tasks_for(df) > 50
    dealt = runtime.dealt_by_range(df, "id")
    assert dealt.rdd.getNumPartitions() == runtime.tasks_for(df) and dealt.count() == 20_000


@pytest.mark.parametrize("shipped", [C.SHIPPED_PIECES, 1])
def test_token_ids_keep_their_order(spark, monkeypatch, shipped):
    monkeypatch.setattr(C, "SHIPPED_PIECES", shipped)
    vocabulary = spark.createDataFrame([("a", 0), ("b", 1)], "piece string, id long")
    rows = spark.createDataFrame([(1, ["b", "a", "b"]), (1, ["b", "a", "b"]), (2, ["a", "z", "z"]), (3, []), (4, None), (5, ["y", None, "a", "x"]), (6, [None, "b"])], "k int, t array<string>")
    got = sorted((r.k, r.ids, r.unknown) for r in C.token_ids(rows, "t", vocabulary).collect())
    assert got == [(1, [1, 0, 1], []), (1, [1, 0, 1], []), (2, None, ["z"]), (3, [], []), (4, [], []), (5, None, ["x", "y"]), (6, [None, 1], [])]
    assert C.token_ids(rows.limit(0), "t", vocabulary).collect() == [] and C.token_ids(rows.where("k = 1"), "t", vocabulary.limit(0)).first().ids is None


def test_where_to_resume(spark):
    def at(*paths):
        return spark.createDataFrame([(p,) for p in paths], "path string")

    one, two = ["o/phase1/checkpoint-5", "o/phase1/checkpoint-40"], ["o/checkpoint-9", "o/checkpoint-10", "o/checkpoint-x", "p/checkpoint-99"]
    assert C.resume_point(at(*one, *two), "o") == ("o/checkpoint-10", 2)
    assert C.resume_point(at(*one), "o") == ("o/phase1/checkpoint-40", 1)
    assert C.resume_point(at("p/checkpoint-1"), "o") == (None, 1)
    assert C.resume_point(at(*two), "o", "x/phase1/checkpoint-3") == ("x/phase1/checkpoint-3", 1)


def test_checks_stop_at_the_first_failure(spark):
    rows = lambda *passed: C.checked_in_order(spark.createDataFrame(list(enumerate(passed)), "step int, passed boolean")).count()
    assert (rows(True, False, True, False), rows(True, True), rows(False)) == (2, 2, 1)


def test_script_and_blanks_match_plain_versions(spark):
    blocks = {"en": (0, 0x7F), "hi": (0x900, 0x97F), "bn": (0x980, 0x9FF), "gu": (0xA80, 0xAFF), "te": (0xC00, 0xC7F), "kn": (0xC80, 0xCFF)}

    def plain(text):
        counts = {}
        for c in text:
            for lang, (lo, hi) in blocks.items():
                if lo <= ord(c) <= hi:
                    counts[lang] = counts.get(lang, 0) + 1
        return max(counts, key=counts.get) if counts else "en"

    rng = random.Random(6)
    texts = ["".join(rng.choices("a b.अबবাગુకిಕé日", k=rng.randint(0, 6))) for _ in range(600)]
    texts += ["".join(rng.choices("a  b\t\n\x0b\x1c\x1f\x85\xa0      　​᠎", k=rng.randint(0, 8))) for _ in range(600)]
    got = spark.createDataFrame([(t,) for t in texts], "x string").select("x", T.script(F.col("x")).alias("lang"), T.clean(F.col("x")).alias("clean")).collect()
    assert [(r.lang, r.clean) for r in got] == [(plain(r.x), " ".join(r.x.split())) for r in got]


def test_prompts_end_where_the_answer_begins(spark):
    df = spark.createDataFrame([("hi", "G", "S")], "t string, g string, s string")
    t, g, s = (F.col(c) for c in "tgs")
    got = df.select(T.train_prompt(t), T.train_completion(g, s), T.inference_prompt(t, g)).first()
    assert tuple(got) == (
        "<|task_tts|><|start_content|>hi<|end_content|>", "<|start_global_token|>G<|end_global_token|><|start_semantic_token|>S<|end_semantic_token|><|im_end|>",
        "<|task_tts|><|start_content|>hi<|end_content|><|start_global_token|>G<|end_global_token|><|start_semantic_token|>",
    )


def test_each_row_has_its_own_language(spark):
    rows = [(1, "5% ₹2", "hi"), (2, "5% ₹2", "en"), (3, "नमस्ते दुनिया 5%", None), (4, "5% ₹2", None), (5, "5%", "kn"), (6, None, "hi")]
    df = spark.createDataFrame(rows, "id int, t string, lang string")
    got = {r.id: r.n for r in df.select("id", T.normalise(F.col("t"), F.col("lang")).alias("n")).collect()}
    assert got == {1: "5 pratishat 2 rupaye", 2: "5 percent 2 rupees", 3: "नमस्ते दुनिया 5 pratishat", 4: "5 percent 2 rupees", 5: "5 percent", 6: None}
    said = {r.id: r.n for r in df.select("id", spoken.processed(F.col("t"), F.col("lang"), {"en": spoken.english_number}).alias("n")).collect()}
    assert said[2] == "five percent two rupees" and said[1] == got[1]
    chunks = df.select("id", T.normalised_chunks(F.col("t"), None).alias("c")).where("id = 3").first().c
    assert chunks == ["नमस्ते दुनिया 5 pratishat"]


def test_words_in_another_script(spark):
    assert [spoken.itrans(w, "hi") for w in ("namaste", "bhaarat", "kSha", "raam", "auShadh")] == ["नमस्ते", "भारत्", "क्ष", "राम्", "औषध्"]
    assert spoken.itrans("namaste", "kn") == "ನಮಸ್ತೇ" and spoken.itrans("bhaasha", "bn") == "ভাশ"
    df = spark.createDataFrame([("ek namaste 7 A", "kn"), ("namaste", None)], "t string, lang string")
    assert [r[0] for r in df.select(spoken.processed(F.col("t"), F.col("lang"), mapper=spoken.itrans)).collect()] == ["ಏಕ್ ನಮಸ್ತೇ 7 A", "नमस्ते"]


def test_chunks_of_very_many_sentences(spark):
    """Against a plain fold, over block edges; time grows about in proportion."""
    def plain(parts):
        done, cur, n = [], [], 0
        for x in parts:
            if cur and n + len(x) > 360:
                done, cur, n = [*done, " ".join(cur)], [], 0
            cur, n = [*cur, x], n + len(x)
        return done + [" ".join(cur)] * bool(cur)

    rng = random.Random(3)
    for n in (0, 1, 255, 256, 257, 1000):
        parts = ["w" * rng.choice((1, 20, 200, 361)) + "." for _ in range(n)]
        assert one(spark, " ".join(parts), T.chunked) == plain(parts), n
    began = time.time()
    assert spark.createDataFrame([("Ein Satz von mir. " * 160_000,)], "t string").select(F.size(T.chunked(F.col("t")))).first()[0] > 7000
    assert time.time() - began < 40
    assert one(spark, None, T.chunked) is None


def test_both_caps_count_before_either(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["en", "en", "en", "de", "hi", "kn", None])) for i in range(400)]
    for k, share in ((60, 0.4), (None, 0.2), (10, 0.9), (50, 0.0)):
        order = sorted(rows, key=lambda r: (hashlib.md5(f"42:{r[0]}".encode()).hexdigest(), r[0]))
        others = sum(lang not in ("en", "de") for _, lang in rows)
        most = int(share / (1 - share) * others) if 0 < share < 1 else None
        kept, per, base = [], {}, 0
        for i, lang in order:
            if k is not None and per.get(lang, 0) >= k or (most is not None and lang in ("en", "de") and base >= most):
                continue
            base += lang in ("en", "de")
            per[lang] = per.get(lang, 0) + 1
            kept.append(i)
        got = C.balanced_capped(spark.createDataFrame(rows, "doc_id long, lang string"), ["en", "de"], share, k)
        assert sorted(r.doc_id for r in got.collect()) == sorted(kept), (k, share)


def test_rows_that_fail_are_told_and_counted(spark):
    none, some = [], [1, 2]
    rows = [(1, "a", some, some), (2, " ", some, some), (3, "a", none, some), (4, "a", some, None), (5, "a", [0] * 20, some), (6, None, some, some)]
    df = spark.createDataFrame(rows, "vec_id int, text string, global_ids array<int>, semantic_ids array<int>")
    prompt = F.array(F.lit(7))
    good, bad, seen = C.tolerant(df, C.refused(prompt, 20))
    assert [r.vec_id for r in good.collect()] == [1] and seen.get == {"rows": 6, "errors": 5}
    assert {r.vec_id: r.reason for r in bad.collect()} == {2: "empty_text", 3: "no_global_ids", 4: "no_semantic_ids", 5: "no_room", 6: "empty_text"}
    assert [r.vec_id for r in C.training_rows(df.where("text = 'a'"), prompt, 20).collect()] == [1]


def test_shorter_chunks_than_the_overlap_join_like_rows(spark):
    rng = random.Random(7)
    rows = [(g, i, [rng.uniform(-1, 1) for _ in range(rng.choice((0, 1, 2, 3, 9, 30)))]) for g in range(12) for i in range(5)]
    df = spark.createDataFrame(rows, "g int, i int, w array<double>")
    want = {}
    for r in C.crossfaded(df, "g", "i", "w", 4).collect():
        want.setdefault(r.g, {})[r.pos] = r.sample
    got = {r.g: r.w for r in scoring.joined_waves(df, "g", "i", "w", 4).collect()}
    assert got.keys() == want.keys()
    for g, w in got.items():
        assert w == pytest.approx([want[g].get(p, 0.0) for p in range(len(w))]) and max(want[g]) == len(w) - 1


def test_move_plan_and_orphans(spark):
    inner, spicor = "hi/IISc_SYSPIN_Data/IISc_SYSPIN_Data", "hi/IISc_SPICOR_Data/IISc_SPICOR_Data"
    dirs = [f"root/{x}" for x in (f"{inner}/IISc_SYSPINProject_a", f"{inner}/other", "hi/IISc_SYSPIN_Data/IISc_SYSPINProject_a", f"{spicor}/IISc_SPICORProject_b", "HINDI/IISc_SPICOR_Data/IISc_SPICOR_Data/IISc_SPICORProject_c")]
    got = {(r.src, r.dst, r.kind, r.action) for r in C.move_plan(spark.createDataFrame([(x,) for x in dirs], "path string")).collect()}
    assert got == {(dirs[0], dirs[2], "syspin", "skip_exists"), (dirs[3], "root/hi/IISc_SYSPIN_Data/IISc_SYSPINProject_SPICOR_b", "spicor", "move")}
    wavs, texts = (spark.createDataFrame(x, "s string, k string") for x in ([("a", "1"), ("a", "2"), ("b", "1")], [("a", "2"), ("a", "3"), ("a", "4"), ("c", "9")]))
    assert {tuple(map(str, r)) for r in C.orphans(wavs, texts, "s", "k").collect()} == {("a", "2", "1", "['3', '4']", "['1']"), ("b", "0", "1", "[]", "['1']"), ("c", "1", "0", "['9']", "[]")}


def test_sentences_against_a_plain_cut(spark):
    """White space of all kinds around the cuts; and the cut of long texts costs less than 2.5 times as much as cleaning them."""
    rng = random.Random(5)
    texts = ["".join(rng.choices("ab。अ.!?।॥ \t\n\x1c\x1f\x85\xa0 ​\U0001f600", k=rng.randint(0, 40))) for _ in range(600)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.sentences(F.col("t")).alias("s"))
    got = [r.s for r in rows.orderBy("i").collect()]
    assert got == [[p for p in (x.strip() for x in re.findall("[^।॥?!.]*[।॥?!.]+|[^।॥?!.]+", t)) if p] for t in texts]
    assert one(spark, None, T.sentences) is None
    long = spark.range(400).repartition(4).select(F.repeat(F.lit("Ein Satz, den keiner von uns oft genug sagt. "), 1000).alias("t")).cache()

    def seconds(f):
        took = []
        for _ in range(3):
            began = time.time()
            long.select(f(F.col("t")).alias("y")).write.format("noop").mode("overwrite").save()
            took.append(time.time() - began)
        return min(took)

    cut, cleaned = seconds(T.sentences), seconds(T.clean)
    long.unpersist()
    assert cut < 2.5 * cleaned
