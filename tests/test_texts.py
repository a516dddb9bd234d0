"""Splitting, number formats, statuses, scaling and answers, each on the cases in which its rule turns."""

import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrospark.functions import prompts, splitter
from hydrospark.operators import answers, inventory, loading, places
from hydrospark.sources.shared import ship

NAN = float("nan")


def plain_split(text, size, overlap, separators):
    """The rule as a recursion over lists: cut in front of a separator, merge what is small, split on what is large."""
    separator = next((s for s in separators if s == "" or s in text), separators[-1])
    finer = separators[separators.index(separator) + 1 :]
    parts = re.split(f"({re.escape(separator)})", text) if separator else list(text)
    pieces = [x for x in ([parts[0]] + [a + b for a, b in zip(parts[1::2], parts[2::2])] if separator else parts) if x]

    def merge(some):
        out, now = [], []
        for x in some:
            if now and len("".join(now)) + len(x) > size:
                out.append("".join(now))
                while now and (len("".join(now)) > overlap or len("".join(now)) + len(x) > size):
                    now = now[1:]
            now = [*now, x]
        return [x.strip() for x in [*out, "".join(now)] if x.strip()]

    out, small = [], []
    for x in pieces:
        if len(x) < size:
            small.append(x)
        else:
            out += merge(small)
            small = []
            out += plain_split(x, size, overlap, finer) if finer else [x.strip()] * bool(x.strip())
    return out + merge(small)


def test_splitter_equals_plain_version():
    r = random.Random(1)
    for _ in range(1000):
        text = "".join(r.choice(["a", "bb", "word", " ", " ", "\n", "\n\n", "ü", "long" * 12]) for _ in range(r.randint(1, 120)))
        size = r.choice([5, 20, 40])
        overlap = r.choice([0, 3, size // 2])
        assert [*splitter.split_text(text, size, overlap)] == plain_split(text, size, overlap, splitter.SEPARATORS)
    assert [*splitter.split_text("no space in this", 4, 0, ("\n",))] == ["no space in this"]


def test_splitter_is_linear_and_takes_nulls(spark):
    began = time.time()
    assert len([*splitter.split_text("x" * 2_000_000)]) > 2000 and len([*splitter.split_text("ab " * 700_000)]) > 2000
    assert time.time() - began < 20
    ship(spark)
    rows = spark.createDataFrame([(1, None), (2, ""), (3, " \n "), (4, "short")], "id int, text string")
    assert [r.c for r in rows.select("id", splitter.recursive_chunks(F.col("text")).alias("c")).orderBy("id").collect()] == [[], [], [], ["short"]]


def test_number_formats_equal_pythons(spark):
    r = random.Random(3)
    values = [0.0, -0.0, 1.0, -1.5, 12345.0, 1234500.0, 1235500.0, 9999.5, 99999.0, 0.0001, 0.00012345, 0.000099999, 1e-7, 1e7, 123456789.25, 1.5e16, 2e22, 0.001, 0.00099, 100.0, 5280.0, 0.5088, 9.9996]
    values += [r.uniform(-1, 1) * 10 ** r.randint(-9, 18) for _ in range(400)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", prompts.general(F.col("v")).alias("g"), prompts.shortest(F.col("v")).alias("s"))
    for x in rows.collect():
        assert x.g == f"{x.v:.4g}" or x.v == 0, (x, f"{x.v:.4g}")
        assert x.s == repr(x.v) or float(x.s) == x.v and ("e" in x.s) == ("e" in repr(x.v)) and len(x.s) <= 24, x
    assert sum(x.s != repr(x.v) for x in rows.collect()) < 40
    x = spark.range(1).select(prompts.general(F.lit(NAN)).alias("n"), prompts.general(F.lit(float("-inf"))).alias("i"), prompts.shortest(F.lit(None).cast("double")).alias("o")).first()
    assert tuple(x) == ("nan", "-inf", "None")


PIXEL = "body_id string, date string, row int, col int, inside boolean, b02 double, b03 double"


def test_scaling_takes_the_quantile_of_finite_values(spark):
    r = np.random.default_rng(5)
    scenes = {"clipped": [5000.0] * 5 + [NAN] * 995, "plain": [0.5] * 1000, "none": [NAN, float("inf"), None], "edge": [1.0] * 98 + [3.0] * 2, "single": [7.0], "minus": [-5.0, 1.0]}
    scenes |= {f"r{i}": [*(r.choice([1.9, 2.0, 2.1, 1.0, NAN], r.integers(1, 250), p=[0.3, 0.3, 0.01, 0.29, 0.1])), *[2.5] * int(r.integers(0, 4))] for i in range(40)}
    rows = [("b", d, i, 0, True, None if v is None else float(v), None if v is None else float(v) / 2) for d, own in scenes.items() for i, v in enumerate(own)]
    got = loading.scaled(spark.createDataFrame(rows, PIXEL), ("b02", "b03")).collect()
    assert len(got) == len(rows)
    for d, own in scenes.items():
        v = np.array([x for y in own if y is not None for x in (y, y / 2)], float)
        v = v[np.isfinite(v)]
        by = 0.0 if not len(v) else 1e-4 if np.percentile(v, 99) > 2 else 1.0
        for x in (x for x in got if x.date == d):
            y = own[x.row]
            if by == 0:
                assert (x.b02, x.b03) == (0.0, 0.0)
            elif y is None or math.isnan(y):
                assert x.b02 is None if y is None else math.isnan(x.b02)
            else:
                assert math.isclose(x.b02, y * by) and math.isclose(x.b03, y / 2 * by)


def test_crop_keeps_rows_and_columns_that_hold_the_area(spark):
    rows = [("b", d, i, j, (i, j) in ({(3, 2), (5, 6)} if d == "x" else {(0, 0)} if d == "y" else set()), float(i), float(j)) for d in "xyz" for i in range(8) for j in range(8)]
    got = {(x.date, x.row, x.col): (x.b02, x.b03) for x in loading.crop(spark.createDataFrame(rows, PIXEL)).collect()}
    assert got == {("x", i - 3, j - 2): (float(i), float(j)) for i in (3, 5) for j in (2, 6)} | {("y", 0, 0): (0.0, 0.0)}


def test_a_folder_without_known_bands(spark):
    m = spark.createDataFrame([("b", "20240101", "notes.txt", 1, 1), ("b", "20240102", "B2.tif", 1, 1), ("b", "20240103", "SCL.tif", 1, 1)], "body_id string, date string, file string, size long, mtime long")
    asked = spark.createDataFrame([("b", f"2024010{i}") for i in range(1, 5)], "body_id string, date string")
    bands = inventory.resolve_bands(m)
    got = {r.date[-1]: (r.status, r.reason) for r in loading.load_status(asked, bands, ("b02", "scl"), m).collect()}
    assert got == {"1": ("incomplete", "missing_reference_band"), "2": ("incomplete", "missing_bands:scl"), "3": ("incomplete", "missing_reference_band"), "4": ("missing", "scene_folder_missing")}
    bodies, none = spark.createDataFrame([("b",)], "body_id string"), spark.createDataFrame([], "body_id string, date string, status string, reason string")
    status = loading.scene_status(asked, bodies, inventory.scene_bands(bands, ("b02",), m), none, none)
    assert {r.date[-1]: (r.status, r.reason) for r in status.collect()} == {"1": ("unusable", "missing_bands:b02"), "2": ("ok", None), "3": ("unusable", "missing_bands:b02"), "4": ("missing", "scene_folder_missing")}


def test_the_first_place_of_a_name_counts(spark):
    pairs = spark.createDataFrame([(1, 5, 900.0), (1, 6, 100.0), (1, 7, 300.0), (1, 8, 300.0), (1, 9, 1.0)], "key int, `to` int, metres double")
    names = spark.createDataFrame([(5, "a"), (6, "a"), (7, "c"), (8, "b"), (9, "")], "key int, name string")
    assert [(r.name, r.km) for r in places.nearby(pairs, names, 3).orderBy("rank").collect()] == [("c", 0.3), ("b", 0.3), ("a", 0.9)]


CARD = "evidence_id string, contributing array<string>, confidence double, extent_m2 double, extent_change_m2 double, date string, comparisons array<struct<o: int, indicator: string, value: double, mean: double, std: double, sigma: double, threshold: double, crossed: boolean, samples: long, fused: boolean>>"


@pytest.fixture(scope="module")
def asked(spark):
    passages = spark.createDataFrame([("p1", "Turbidity", "sediment in water"), ("p2", None, "sigma of a threshold")], "passage string, title string, text string")
    comparison = (2, "turbidity", 14.0, 10.0, None, 4.0, 3.0, True, 9, True)
    cards = spark.createDataFrame([("ev", ["turbidity"], 0.5, None, None, "20240101", [comparison])], CARD)
    questions = [("both", "Why turbidity?", "ev"), ("corpus", "sediment", None), ("card", "zzz", "ev"), ("nothing", "zzz", None), ("silent", "", "ev"), ("lost", "sediment", "gone")]
    return passages, cards, spark.createDataFrame(questions, "question string, text string, evidence_id string")


def test_answers_on_every_branch(spark, asked):
    passages, cards, questions = asked
    got = {r.question: r for r in answers.answered(questions, passages, cards).collect()}
    assert len(got) == 6
    state = {k: (r.source_ids, r.evidence_id, r.source, r.confidence, r.reasons, r.grounded) for k, r in got.items()}
    assert state["both"] == (["p1"], "ev", "llm_disabled", 0.5, ["corpus", "pipeline_evidence", "llm_disabled"], True)
    assert state["corpus"] == (["p1"], None, "llm_disabled", 0.75, ["corpus", "llm_disabled"], True)
    assert state["card"] == ([], "ev", "llm_disabled", 0.5, ["pipeline_evidence", "llm_disabled"], True)
    assert state["nothing"] == ([], None, "template", 0.2, ["template", "not_in_corpus"], False)
    assert set(state["silent"][0]) == {"p1", "p2"} and state["lost"] == state["corpus"]
    assert got["both"].answer.startswith(prompts.BASE_HEADING) and "± None, deviation 4.00σ" in got["both"].answer and got["nothing"].answer == prompts.NOT_KNOWN
    drafts = spark.createDataFrame([("both", "A value of 14."), ("card", "It reached 99."), ("corpus", " 1234 "), ("silent", "  "), ("nothing", "I know.")], "question string, draft string")
    got = {r.question: (r.source, r.answer, r.reasons, r.grounded) for r in answers.answered(questions, passages, cards, drafts).collect()}
    assert got["both"][:2] == ("llm", "A value of 14.") and got["both"][2] == ["corpus", "pipeline_evidence"]
    assert got["card"][0] == "llm_rejected" and got["card"][1].startswith(prompts.CARD_HEADING) and got["corpus"][:2] == ("llm", "1234")
    assert got["lost"][0] == "llm_unreachable" and got["silent"][0] == "llm" and got["silent"][1].startswith(prompts.BASE_HEADING) and got["nothing"][0] == "template" and not got["nothing"][3]


def test_prompts_hold_passages_evidence_and_turns(spark, asked):
    passages, cards, questions = asked
    turns = F.when(F.col("question") == "both", F.array(*(F.struct(F.lit(w).alias("role"), F.lit(x).alias("text")) for w, x in (("user", "Hi"), ("bot", "Hello")))))
    got = {r.question: r.prompt.split("\n\n") for r in answers.prompted(questions.withColumn("turns", turns), passages, cards, system="Rules.").collect()}
    both = got["both"]
    assert both[0] == "Rules." and both[2] == "[Source: p1]\nTitle: Turbidity\nsediment in water" and both[3] == prompts.EVIDENCE_HEADING and '"evidence_id":"ev"' in both[4]
    assert both[5:] == ["=== CONVERSATION HISTORY ===", "User: Hi", "Assistant: Hello", "=== USER QUESTION ===\nWhy turbidity?"]
    assert got["nothing"][1].endswith("(No relevant passages found for this question.)") and len(got["nothing"]) == 3
