from tessera.operators import sections


def paras(spark, *rows):
    return spark.createDataFrame([("b", p, i, t) for i, (p, t) in enumerate(rows)], "doc string, page int, seq int, text string")


def test_answers_far_from_their_questions(spark):
    rows = [(1, "Section I"), (2, "1. What?"), (3, "2. Which?"), (40, "Section II"), (41, "1. Who?"), (150, "SECTION I again"), (150, "1. The answer is B"), (151, "I-3. Named here"), (151, "2, 3. The answers are A and C"), (170, "4. Of no heading in its window")]
    p = paras(spark, *rows)
    found = {(r.section, r.start, r.end, r.weight) for r in sections.spans(p).collect()}
    assert found == {("I", 2, 151, 6), ("II", 41, 41, 1)}
    got = {(r.section, r.start, r.end, r.questions, r.answered) for r in sections.index(p).collect()}
    # read as one piece, the first section holds the second's heading, whose question is then not its own
    assert got == {("I", 2, 151, 3, 3), ("II", 41, 41, 1, 0)}


def test_heaviest_are_kept_and_empty_goes_through(spark):
    rows = [(1, "Section I"), (1, "1. a b"), (2, "Section II"), (2, "1. a b"), (2, "2. a b"), (3, "Section III"), (3, "1. a b")]
    p = paras(spark, *rows)
    assert [r.section for r in sections.index(p, 2).orderBy("section").collect()] == ["I", "II"]
    assert sections.index(p.limit(0)).count() == 0
    assert sections.index(paras(spark, (1, None), (1, "prose"))).count() == 0


def test_no_paragraph_is_read_more_than_once(spark):
    # nine pieces that overlap, and long windows: rows between stages stay as many as the paragraphs
    rows = [(p, f"Section {'I' * (p % 3 + 1)}") for p in range(1, 100)] + [(p, "IV-1. The answer is B") for p in range(1, 100)] + [(p, f"{p}. Why so?") for p in range(1, 100)]
    p = paras(spark, *sorted(rows))
    found = sections.items(p)
    assert found.count() == 198 and "Expand" not in (plan := sections.index(p)._jdf.queryExecution().optimizedPlan().toString())
    assert "sequence(" not in plan  # pages of pieces are not made one by one and joined
    got = {r.section: (r.start, r.end, r.questions, r.answered) for r in sections.index(p).collect()}
    assert got["IV"] == (1, 99, 0, 0) and got["I"] == (4, 94, 31, 0)
