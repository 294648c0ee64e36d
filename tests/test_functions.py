"""Expressions against literal pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import extract, json_fields, metrics, normalize, prompts, text


def check(evaluate, function, pairs, schema="v string"):
    inputs = [pair[0] for pair in pairs]
    assert evaluate(function, inputs, schema) == [pair[1] for pair in pairs]


def test_normalize_answer(evaluate):
    check(
        evaluate,
        normalize.normalize_answer,
        [
            ("The Quick, Brown Fox!", "quick brown fox"),
            ("  lots   of   space  ", "lots of space"),
            ("A big red dog", "big red dog"),
            (None, ""),
            ("na\u00efve a\u3000 the", "na\u00efve"),
            # Articles next to a sign that is no word character.
            ("x\u2013a\u2013y", "x\u2013 \u2013y"),
            ("th\u00e9 an\u00e9 the\u0301", "th\u00e9 an\u00e9 \u0301"),
            ("line\none\x1ctwo\u2028three", "line one two three"),
            ("it's can't", "its cant"),
        ],
    )


def test_strip_and_slug(evaluate):
    check(evaluate, text.strip, [("\u3000 x y \x1c\n", "x y"), ("", ""), (None, None)])
    check(
        evaluate,
        text.slug,
        [(" a b/c ", "a_b_c"), ("__x__", "x"), ("///", "value"), ("m-1.0_z", "m-1.0_z")],
    )


def test_stable_id_and_source(evaluate):
    import hashlib

    want = hashlib.md5(b"FEVER_17").hexdigest()[:12]
    assert evaluate(text.stable_id, [("FEVER", 17)], "s string, k long") == [want]
    check(
        evaluate,
        text.canonical_source,
        [
            ("MuSiQue-v1", "musique"),
            ("narrativeqa", "quality"),
            (" FEVER ", "fever"),
            ("some math", "hardmath"),
            ("HumanEvalPlus", "humaneval_plus"),
            (None, "humaneval_plus"),
        ],
    )


def test_qa_answer(evaluate):
    check(
        evaluate,
        extract.qa_answer,
        [
            ("Paris", "Paris"),
            ("Final Answer: Paris.", "Paris"),
            ("Based on the passages, the answer is Paris.", "Paris"),
            ("Answer: 3.14", "3"),
            ("Let me think\nThe user 5..", "The user 5"),
            ("Based on x\nLooking at y", "Based on x"),
            ("answer: Paris\nbecause it is so", "answer: Paris"),
            ("first, a\r\n  Yes it is. ", "Yes it is"),
            ("one two three four five six seven eight nine ten eleven.",
             "one two three four five six seven eight nine ten eleven."),
            ("ANSWER:\n\n Rome", "Rome"),
            ("", ""),
            (None, ""),
        ],
    )


def test_multihop_answer(evaluate):
    check(
        evaluate,
        extract.multihop_answer,
        [
            ("<scratchpad>s</scratchpad>\nFinal Answer: user 5</scratchpad>", "user 5"),
            ("Final Answer: St. Louis\nmore", "St. Louis"),
            ("In the text\nuser 3.", "user 3"),
        ],
    )


def test_choice_letter(evaluate):
    check(
        evaluate,
        extract.choice_letter,
        [
            ("B", "B"),
            ("(C) Some explanation", "C"),
            ("The answer is (D).", "D"),
            ("The answer is (B).", "B"),
            ("d", "D"),
            ("I would pick B here", "B"),
            ("nonsense", "N"),
            ("", ""),
        ],
    )


def test_fact_labels(evaluate):
    check(
        evaluate,
        extract.fact_label,
        [
            ("SUPPORTS", "SUPPORTS"),
            ("This is refuted.", "REFUTES"),
            ("not enough info", "NOT ENOUGH INFO"),
            ("Not enough information.", "not enough information."),
            ("not true", "SUPPORTS"),
            ("not supported", "SUPPORTS"),
            ("enough", "enough"),
            ("no", "REFUTES"),
            (None, ""),
        ],
    )
    check(
        evaluate,
        extract.loose_fact_label,
        [
            ("The claim is supported by evidence", "SUPPORTED"),
            ("This is refuted", "REFUTED"),
            ("There is not enough information", "NEI"),
            ("not supported", "REFUTED"),
            ("maybe so", "MAYBE"),
        ],
    )
    check(
        evaluate,
        normalize.normalize_label,
        [(" True ", "SUPPORTED"), ("False", "REFUTED"), ("Not Enough Information", "NEI"),
         ("NOT ENOUGH INFO", "NOT ENOUGH INFO"), (None, "")],
    )


def test_math_answer(evaluate):
    check(
        evaluate,
        extract.math_answer,
        [
            (r"so \boxed{1} then \boxed{\frac{1}{5}} x", r"\frac{1}{5}"),
            (r"\boxed{a{b}c} tail }", "a{b}c"),
            (r"\boxed{a{b} open", r"\boxed{a{b} open"),
            (r"\boxed{ } and", ""),
            ("Answer: 5.", "5"),
            ("ANSWER = x + 1", "x + 1"),
            ("the answer is 42.\nmore", "42"),
            ("steps 10 then 20 and 7 done", "7"),
            ("no number", "no number"),
            ("", ""),
        ],
    )
    check(
        evaluate,
        extract.loose_math_answer,
        [
            ("Let me compute... ANSWER: 42.5", "42.5"),
            (r"Therefore \boxed{3.14}", "3.14"),
            ("Step 1: 10, Step 2: 20, Final: 30", "30"),
            ("none", ""),
        ],
    )


def test_code_answer(evaluate):
    check(
        evaluate,
        extract.code_answer,
        [
            ("```python\ndef add(a, b):\n    return a + b\n```", "def add(a, b):\n    return a + b"),
            ("```PY\nx = 1\n```\nbye", "x = 1"),
            ("```\ndef g(x):\n    return x\nprint(g(1))", "def g(x):\n    return x"),
            ("import os\ndef h(y):\n    return y\nif __name__ == 1:\n    h(1)",
             "def h(y):\n    return y"),
            ("def a():\n    # note\n    pass\n\ndef b(): 2",
             "def a():\n    # note\n    pass\n\ndef b(): 2"),
            # A leading comment or from-import hands over to the last definition.
            ("# c\ndef a(): 1\n\ndef b(): 2", "def b(): 2"),
            ("from math import *\nclass A:\n  pass\ndef b(): 2", "def b(): 2"),
            ("Text\nclass A:\n  pass", "class A:\n  pass"),
            ("x = 1\r\n  print(x)\r\n# Example use\r\ny = 2", "x = 1\ny = 2"),
            ("```python3\n\n```", ""),
            ("", ""),
        ],
    )


def test_reasoning_removal(evaluate):
    check(
        evaluate,
        extract.strip_reasoning,
        [("<think>a</think> b </think>c", "c"), ("a</scratchpad> d ", "d"), ("plain", "plain")],
    )
    long = "x" * 2001
    check(
        evaluate,
        extract.clean_answer,
        [("<think>a\nb</think>ok<reasoning>r</reasoning>", "ok"), (long, long), (None, "")],
    )
    check(
        evaluate,
        lambda v: extract.clean_answer(v, 2000),
        [(long, long[:2000] + "..."), (long[:2000], long[:2000]), (None, "")],
    )


def test_unknown_dataset_raises(evaluate):
    with pytest.raises(Exception, match="Unknown dataset: other"):
        evaluate(lambda v: extract.extract_answer(v, F.lit("other")), ["x"])


def test_numbers(evaluate):
    check(
        evaluate,
        metrics.parse_number,
        [("42", 42.0), ("3/4", 0.75), ("3/0", None), ("1,000", 1000.0), ("1_000", 1000.0),
         ("x 3.14e2", 314.0), ("1d", 1.0), (".5", 0.5), ("5.", 5.0), ("no number", None),
         ("-inf", float("-inf")), ("", None)],
    )
    check(
        evaluate,
        metrics.numeric_accuracy,
        [(("42.1", "42"), 1.0), (("50", "42"), 0.0), (("3/4", "0.75"), 1.0), (("inf", "inf"), 1.0),
         (("inf", "1"), 0.0), (("nan", "nan"), 0.0), (("no number here", "42"), 0.0),
         (("After, ANSWER: 3.14", "3.14159"), 1.0)],
        "p string, r string",
    )


def test_latex(evaluate):
    check(
        evaluate,
        normalize.normalize_latex,
        [("{a b}", "ab"), ("{", "{"), ("{}", ""), ("\\left( x \\right)", "(x)"), ("{a}{b}", "a}{b"), (None, "")],
    )
    check(
        evaluate,
        metrics.math_exact_match,
        [(("{ x }", "x"), 1.0), (("", ""), 0.0), (("x", "y"), 0.0)],
        "p string, r string",
    )


def brute_f1(left, right):
    from collections import Counter

    if not left and not right:
        return 1.0
    shared = sum((Counter(left) & Counter(right)).values())
    if not left or not right or not shared:
        return 0.0
    precision, recall = shared / len(left), shared / len(right)
    return 2 * precision * recall / (precision + recall)


def test_token_f1_against_brute_force(evaluate):
    rng = random.Random(7)
    vocabulary = ["red", "dog", "big", "cat", "sun", "x"]
    rows = [("", ""), ("", "dog"), ("The big red dog", "big red dog"), ("cat", "dog")]
    for _ in range(60):
        rows.append(
            tuple(" ".join(rng.choices(vocabulary, k=rng.randint(0, 9))) for _ in range(2))
        )
    got = evaluate(metrics.token_f1, rows, "p string, r string")
    drop = {"a", "an", "the"}
    for (left, right), value in zip(rows, got):
        words = [[w for w in side.lower().split() if w not in drop] for side in (left, right)]
        assert value == brute_f1(*words)
    swapped = evaluate(metrics.token_f1, [(r, p) for p, r in rows], "p string, r string")
    assert swapped == pytest.approx(got)
    exact = evaluate(metrics.exact_match, rows, "p string, r string")
    assert all(f1 == 1.0 for f1, em in zip(got, exact) if em == 1.0)


def test_best_of_many(evaluate):
    schema = "p string, refs array<string>"
    rows = [("Paris", ["London", "paris!"]), ("x", []), ("x", None), ("red dog", ["big red dog"])]
    assert evaluate(metrics.exact_match_multi, rows, schema) == [1.0, 0.0, 0.0, 0.0]
    assert evaluate(metrics.token_f1_multi, rows, schema) == [1.0, 0.0, 0.0, 0.8]


def test_pass_at_k(evaluate):
    rows = [(5, 2), (5, 0), (5, 5), (2, 0)]
    got = evaluate(lambda n, c: metrics.pass_at_k(n, c, 3), rows, "n long, c long")
    assert got == pytest.approx([0.9, 0.0, 1.0, 1.0])


def test_gold_answers(evaluate):
    def quality(value):
        return json_fields.gold_answers(value, F.lit("quality"))

    check(
        evaluate,
        quality,
        [
            ("[{'text': 'Paris', 'tokens': ['P']}, {'text': \"it's\", 'tokens': None}]",
             ["Paris", "it's"]),
            ('[{"text":"a"}]', ["a"]),
            ("['a', 'b']", ["a", "b"]),
            ("[]", ["[]"]),
            ("plain", ["plain"]),
            ("[{'text': 'caf\\xe9'}]", ["caf\u00e9"]),
            (None, []),
        ],
    )
    other = evaluate(lambda v: json_fields.gold_answers(v, F.lit("musique")), ["['a']"])
    assert other == [["['a']"]]


def test_metadata(evaluate):
    got = evaluate(json_fields.parse_metadata, ['{"answerable": true}', "[1]", "bad", "", None])
    assert [row["answerable"] for row in got] == [True, None, None, None, None]


def test_vote_prompt_and_messages(spark):
    row = spark.range(1).select(
        prompts.vote_prompt(
            F.lit("q?"), F.create_map(F.lit("B"), F.lit("b"), F.lit("A"), F.lit("a"))
        ).alias("vote"),
        prompts.resolved_messages(
            F.lit(None).cast("array<" + prompts.MESSAGE + ">"),
            F.lit("sys"),
            F.array(prompts.message("assistant", F.lit("before"))),
            F.lit("ctx"),
            F.lit("ask"),
        ).alias("chat"),
    ).first()
    assert "Question: q?\n\nAnswer A:\na\n\nAnswer B:\nb\n\nWhich" in row["vote"]
    assert [(m["role"], m["content"]) for m in row["chat"]] == [
        ("system", "sys"),
        ("assistant", "before"),
        ("user", "ctx\n\nask"),
    ]
