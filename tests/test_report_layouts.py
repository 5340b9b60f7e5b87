"""Reports of each layout, read by hand."""

from quillwork.operators import report_layouts as L

RULE = "=" * 40
AB = ("RATER A", "RATER B")
DUAL = f"""Report
RATER A EVALUATION
Score: 85.0/100
Recommendation: ACCEPT with care
{RULE}
RATER B EVALUATION
note
Score: 70 / 100
Recommendation:
EVALUATOR COMPARISON
Average: 77.5/100
Score: 1/100"""
FAR = "\n".join(["RATER A EVALUATION", *["x"] * 9, "Score: 5/100", RULE, "Score: 6/100", "later RATER A EVALUATION again", "Recommendation: REJECT"])
CROSSED = "RATER A EVALUATION\nRATER B EVALUATION of Score: 3/100 Score: 4\nRecommendation: REVIEW"


def reports(spark, *texts):
    return spark.createDataFrame([(i, t, "own", 1) for i, t in enumerate(texts)], "doc_id long, report string, rater string, x int")


def values(spark, how, text):
    return [(r.score, r.recommendation) for r in L.rater_values(reports(spark, text), AB, how).orderBy("rater").collect()]


def test_near_values(spark):
    assert values(spark, "near", DUAL) == [("85.0/100", "ACCEPT"), ("70/100", "UNKNOWN")]
    assert values(spark, "near", FAR) == [("N/A", "UNKNOWN")] * 2
    # the other rater's mark is read, and what follows it is not
    assert values(spark, "near", CROSSED) == [("3/100", "UNKNOWN"), ("N/A", "REVIEW")]
    assert values(spark, "near", None) == values(spark, "near", "") == [("N/A", "UNKNOWN")] * 2


def test_ruled_values(spark):
    assert values(spark, "ruled", DUAL) == [("85.0/100", "ACCEPT"), ("70/100", "UNKNOWN")]
    assert values(spark, "ruled", FAR) == [("5/100", "REJECT"), ("N/A", "UNKNOWN")]
    # a section is open until a rule, so the other rater's mark closes nothing
    assert values(spark, "ruled", CROSSED) == [("3/100", "REVIEW"), ("N/A", "REVIEW")]
    assert values(spark, "ruled", f"RATER A EVALUATION\n{RULE}\nScore: 9/100\nRATER A EVALUATION\nScore: /") == [("/100", "UNKNOWN"), ("N/A", "UNKNOWN")]


def test_bodies(spark):
    got = {(r.doc_id, r.rater): r.body for r in L.split_reports(reports(spark, DUAL, FAR, None), AB).collect()}
    assert got[0, "RATER A"] == f"## Rater A Evaluation\nScore: 85.0/100\nRecommendation: ACCEPT with care\n{RULE}"
    assert got[0, "RATER B"] == "## Rater B Evaluation\nnote\nScore: 70 / 100\nRecommendation:"
    assert got[1, "RATER A"].count("## Rater A Evaluation") == 2 and got[1, "RATER A"].endswith("Recommendation: REJECT")
    assert got[1, "RATER B"] is None and got[2, "RATER A"] is None


def test_layouts_and_averages(spark):
    got = L.report_overview(reports(spark, DUAL, FAR, None, " ", L.NO_REPORT, "Average:")).orderBy("doc_id").collect()
    assert [(r.layout, r.average) for r in got] == [("dual", "77.5/100"), ("single", "Unknown"), ("none", "Unknown"), ("none", "Unknown"), ("none", "Unknown"), ("single", "")]
    assert L.rater_values(reports(spark, "a").limit(0), AB).count() == 0


def test_long_reports(spark):
    """Two hundred thousand lines and marks in many of them."""
    text = "\n".join(f"RATER A EVALUATION {i}" if i % 100 == 0 else "x" for i in range(200_000))
    d = reports(spark, text + "\nScore: 4/100")
    assert L.rater_values(d, AB, "ruled").where("rater = 'RATER A'").first().score == "4/100"
    assert len(L.split_reports(d, AB).where("rater = 'RATER A'").first().body.split("\n")) == 200_001
