import random

from quern.llm import spam as S

SCHEMA = "doc_id bigint, text string, lang string, ratio string, n_words string"
EN = "the of and to in that it was for on with as they had not but if when we would".split()
VI = "là của và các được cho không khi đã để với trong có thì nên vì từ đến nhưng chúng".split()
_syllable = random.Random(9)
STEMS = ["".join(_syllable.choice("bcdfghklmnprstvw") + _syllable.choice("aeiou") for _ in range(_syllable.randint(2, 4))) for _ in range(900)]


def prose(rnd, small_words, n):
    """Sentences of varied words, a function word between every two."""
    return " ".join(" ".join(f"{rnd.choice(STEMS)} {rnd.choice(small_words)}" for _ in range(rnd.randint(4, 9))).capitalize() + f" {rnd.choice(STEMS)}." for _ in range(n))


def corpus(rnd):
    docs = [(prose(rnd, EN, rnd.randint(4, 30)), "en", False) for _ in range(120)] + [(prose(rnd, VI, rnd.randint(4, 20)), "vi", False) for _ in range(60)]
    words = ["cheap", "ledger", "hosting", "tool", "buy", "course", "online", "best"]
    docs += [(", ".join(" ".join(rnd.sample(words, 3)) for _ in range(60)), "en", True) for _ in range(4)]
    docs += [("\n".join(f"- [{rnd.choice(words)} {rnd.choice(words)}](https://{rnd.choice(words)}{rnd.randint(1, 99)}.example/{rnd.choice(words)})" for _ in range(25)), "EN ", True) for _ in range(4)]
    docs += [(" ".join(f"#{rnd.choice(words)}{rnd.choice(words)}" for _ in range(60)), None, True) for _ in range(4)]
    docs += [(" ".join(rnd.choice(["phần mềm giá rẻ", "khóa học dữ liệu", "thuê máy chủ"]) for _ in range(60)), "vi", True) for _ in range(4)]
    docs += [("\n".join(f"2025-06-{rnd.randint(10, 28)} 10:{rnd.randint(10, 59)}:00 WARN writer retry {k} of 9" for k in range(40)), "en", False) for _ in range(4)]
    docs += [("day,rows,late\n" + "\n".join(f"2025-06-{rnd.randint(10, 28)},{rnd.randint(1, 99999)},{rnd.randint(1, 9)}" for _ in range(40)), "en", False) for _ in range(4)]
    docs += [("", "en", False), (None, "en", False), ("buy buy buy", "en", False), ("buy cheap ledger tool " * 30000, "en", True)]
    return docs


def test_finds_stuffed_pages_and_spares_logs_and_tables(spark):
    docs = corpus(random.Random(4))
    docs += [docs[185]]  # a copy of a case is a case
    df = spark.createDataFrame([(i, t, lang, "x", "y") for i, (t, lang, _) in enumerate(docs)] + [(None, "buy cheap tool " * 50, "en", "x", "y")], SCHEMA)
    got = {r["doc_id"] for r in S.judged_pages(df).where("is_spam").collect()}
    assert got == {i for i, d in enumerate(docs) if d[2]}


def test_empty_table_and_alike_texts(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert S.judged_pages(df).count() == 0
    same = spark.createDataFrame([(i, "one two three four five six seven eight nine ten eleven twelve", "en", "", "") for i in range(5)], SCHEMA)
    assert S.judged_pages(same).where("is_spam").count() == 0


def test_block_ratio():
    assert S.block_ratio(b"") == 1.0 and S.block_ratio(b"a" * 100_000) < 0.02 < 0.9 < S.block_ratio(random.Random(1).randbytes(50_000))


def test_only_new_sentences_count():
    """A sentence that repeats what came before has an end, but adds next to nothing to the compressed block."""
    rnd = random.Random(7)
    varied = prose(rnd, EN, 30)
    repeated = " ".join("Looking for stock ticks dashboard? Best stock ticks dashboard means stock ticks dashboard." for _ in range(40))
    assert S.measures(varied)[3] > 0.9 and S.measures(repeated)[3] < 0.1
    assert S.measures(varied)[2] > 2 * S.measures(repeated)[2]
    words, size_class, ratio, sentences, machine, ends = S.measures("\n".join(f"2025-06-{d:02d} 10:00:00 WARN retry {d}" for d in range(1, 29)))
    assert machine > 0.9 and sentences == ends == 0
    assert S.measures(None)[0] == S.measures("")[0] == 0 and S.measures("x" * 200_000)[0] == 1


def test_classes_with_few_pages_borrow_from_their_neighbours(spark):
    rows = [(i, "en", 100, 20, 0.5 + i % 10 / 100, 0.0, 0.0, 0.0) for i in range(200)] + [(900 + i, "vi", 100, 21, 0.9, 0.0, 0.0, 0.0) for i in range(3)] + [(950, "en", 5, 3, 1.0, 0.0, 0.0, 0.0)]
    u = {(r["lang"], r["size_class"]): r["median"] for r in S.usual_ratios(spark.createDataFrame(rows, S._MEASURED)).collect()}
    assert set(u) == {("en", 20), ("vi", 21)} and u["vi", 21] < 0.6
