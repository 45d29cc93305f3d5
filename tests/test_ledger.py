"""The ledger of answers and the rounds of rewriting, with a provider that writes down every call."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from oreline.operators import rewrite
from oreline.sources import provider
from oreline.sources.ledger import Ledger


class Counting:
    """Notes each prompt in a file of the folder; breaks off, or fails softly, at some."""

    def __init__(self, folder, breaks=(), fails=()):
        self.folder, self.breaks, self.fails = folder, breaks, fails

    def generate(self, prompts):
        for p in prompts:
            with open(f"{self.folder}/calls", "a") as f:
                f.write(p + "\n")
        if any(p in self.fails for p in prompts):
            raise ValueError("no")
        if any(p in self.breaks for p in prompts):
            raise SystemExit("the machine is gone")
        return [f"<{p}>" for p in prompts]

    def embed(self, texts):
        return [[float(len(x))] for x in self.generate(texts)]


def calls(folder):
    with open(f"{folder}/calls") as f:
        return Counter(f.read().split("\n")[:-1])


def test_a_prompt_is_asked_once(spark, tmp_path):
    here = str(tmp_path)
    rows = spark.createDataFrame([(i, f"p{i % 7}" if i < 20 else None) for i in range(25)], "id int, p string")
    ledger = Ledger(spark, f"{here}/ledger", batch=3)
    for _ in range(2):
        got = {r.id: r.a for r in ledger.generate(rows, "p", "a", lambda: Counting(here)).collect()}
        assert got == {i: f"<p{i % 7}>" if i < 20 else None for i in range(25)}
    assert calls(here) == {f"p{i}": 1 for i in range(7)}
    # another salt asks anew, another column is filled
    assert ledger.generate(rows, "p", "b", lambda: Counting(here), salt="again").where("b IS NOT NULL").count() == 20
    assert set(calls(here).values()) == {2}
    vectors = {r.id: r.v for _ in range(2) for r in ledger.embed(rows, "p", "v", lambda: Counting(here)).collect()}
    assert vectors[0] == [4.0] and vectors[24] == [2.0] and calls(here)["p0"] == 3 and calls(here)[""] == 1


def test_a_crash_and_a_rerun(spark, tmp_path):
    """What was answered before a crash is not asked again; only the round that broke off is."""
    here = str(tmp_path)
    rows = spark.createDataFrame([(f"p{i}",) for i in range(40)], "p string")
    ledger = Ledger(spark, f"{here}/ledger", batch=5)
    with pytest.raises(Exception, match="(?i)stage|job|worker"):
        ledger.generate(rows, "p", "a", lambda: Counting(here, breaks={"p17"})).collect()
    done = {r.value for r in ledger.read().collect()}
    before = calls(here)
    assert ledger.generate(rows, "p", "a", lambda: Counting(here)).where("a IS NULL").count() == 0
    more = calls(here) - before
    assert not {f"<{p}>" for p in more} & done and set(more.values()) == {1} and len(done) + len(more) == 40
    assert "p17" in more
    assert ledger.generate(rows, "p", "a", lambda: Counting(here)).count() == 40 and calls(here) == before + more


def test_failures_are_asked_again(spark, tmp_path):
    here = str(tmp_path)
    rows = spark.createDataFrame([("x",), ("y",)], "p string")
    ledger = Ledger(spark, f"{here}/ledger", batch=1)
    assert {r.p: r.a for r in ledger.generate(rows, "p", "a", lambda: Counting(here, fails={"x"})).collect()} == {"x": None, "y": "<y>"}
    assert {r.p: r.a for r in ledger.generate(rows, "p", "a", lambda: Counting(here)).collect()} == {"x": "<x>", "y": "<y>"}
    assert calls(here) == {"x": 2, "y": 1} and ledger.generate(rows.limit(0), "p", "a", lambda: Counting(here)).count() == 0


GOOD = {"hook": "Builders keep losing hours to flaky tests every week", "explanation": "It hurts.", "why_bullets": ["why"], "who": "Teams", "wedge": "Start with teams who test, build a rerunner.", "evidence_snippets": ["flaky again"], "links": ["http://invented"], "strength_or_impact": "High"}


class Stubborn(Counting):
    """By the kind of draft: valid, valid when told the faults, valid when asked a second time, never."""

    def generate(self, prompts):
        seen = calls(self.folder) if self._begun() else Counter()
        out = []
        for p in prompts:
            kind = p.split("Kind: ")[1][0]
            line = p.replace("\n", "~")
            ok = kind == "0" or (kind == "1" and p.startswith("Your JSON")) or (kind == "2" and seen[line] > 0)
            out.append(json.dumps(GOOD) if ok else "[1" if kind == "2" else json.dumps(GOOD | {"hook": "short", "wedge": "This highlights it"}))
        super().generate([p.replace("\n", "~") for p in prompts])
        return out

    def _begun(self):
        try:
            return bool(calls(self.folder))
        except FileNotFoundError:
            return False


def test_rewriting_in_rounds(spark, tmp_path):
    here = str(tmp_path)
    rows = spark.range(4).select(
        "id", F.col("id").cast("string").alias("kind"), F.struct(F.lit("A title of some words").alias("title"), F.lit("It fails.").alias("summary"), F.lit("Teams").alias("persona"), F.lit("").alias("why_matters")).alias("draft"),
        F.struct(F.array(F.lit("one two")).alias("snippets"), F.array(F.lit("http://a"), F.lit("http://b")).alias("links")).alias("found"), F.lit("odd").alias("grade"),
    )
    ledger = Ledger(spark, f"{here}/ledger")
    got = {r.id: r for r in rewrite.rewrite_items(rows, ledger, lambda: Stubborn(here)).collect()}
    assert [got[i].made_by for i in range(4)] == ["first", "repaired", "second", "template"]
    # links that the evidence hasn't are replaced by its own
    assert all(got[i].item.hook == GOOD["hook"] and got[i].item.links == ["http://a", "http://b"] for i in range(3))
    assert got[3].item.hook == "A title of some words — worth watching." and got[3].item.strength_or_impact == "Med"
    asked = Counter((p.split("Kind: ")[1][0], p.startswith("Your JSON")) for p in calls(here).elements())
    assert asked == {("0", False): 1, ("1", False): 1, ("1", True): 1, ("2", False): 2, ("3", False): 2, ("3", True): 1}
    told = next(p for p in calls(here) if p.startswith("Your JSON") and "Kind: 3" in p)
    assert "hook must be 8–14 words; banned phrase in content" in told
    # a rerun asks nobody
    assert rewrite.rewrite_items(rows, ledger, lambda: Stubborn(here)).count() == 4 and sum(calls(here).values()) == 8
    assert rewrite.rewrite_items(rows.limit(0), ledger, provider.StubProvider).count() == 0


def test_many_prompts_take_few_rounds(spark, tmp_path):
    """Each round is a job; their number does not grow with the prompts."""
    here = str(tmp_path)
    rows = spark.range(60).select(F.concat(F.lit("p"), "id").alias("p"))
    ledger = Ledger(spark, f"{here}/ledger", batch=1)
    assert ledger.generate(rows, "p", "a", lambda: Counting(here)).where("a = concat('<', p, '>')").count() == 60
    written = {"-".join(p.name.split("-")[2:7]).split(".")[0] for p in (tmp_path / "ledger" / "answers").glob("part-*")}
    assert 1 < len(written) <= 16 and set(calls(here).values()) == {1}


def test_rows_are_worked_out_once(spark, tmp_path):
    """What the prompts are made of is not run again in each round, nor when the answers are joined."""
    here = str(tmp_path)

    def noted(i):
        with open(f"{here}/rows", "a") as f:
            f.write(f"{i}\n")
        return f"p{i}"

    rows = spark.range(12).select("id", F.udf(noted)("id").alias("p"))
    ledger = Ledger(spark, f"{here}/ledger", batch=3)
    assert ledger.generate(rows, "p", "a", lambda: Counting(here)).where("a = concat('<', p, '>')").count() == 12
    with open(f"{here}/rows") as f:
        assert Counter(f.read().split()) == {str(i): 1 for i in range(12)}


def test_two_readings_of_a_growing_ledger(spark, tmp_path):
    """A result that is read later, beside one of the grown ledger, holds the answers of its own time."""
    here = str(tmp_path)
    ledger = Ledger(spark, f"{here}/ledger")
    one = ledger.generate(spark.createDataFrame([(1, "x")], "id int, p string"), "p", "a", lambda: Counting(here))
    two = ledger.generate(spark.createDataFrame([(2, "y"), (3, None)], "id int, p string"), "p", "a", lambda: Counting(here))
    assert {r.id: r.a for r in one.unionByName(two).collect()} == {1: "<x>", 2: "<y>", 3: None}
