"""A notice that only the text as a whole shows."""
from tesserae.llm import license_scan


def test_notice_split_by_blank_lines(spark):
    words = license_scan.TEMPLATES[1][1].split()
    notice = "\n\n".join(" ".join(words[i:i + 7]) for i in range(0, len(words), 7))
    rows = [("a/x", notice), ("a/y.py", "x = 1"), *((f"b/{i}", f"other words {i}") for i in range(20))]
    got = {r.path: (r.license, r.how, r.from_dir) for r in license_scan.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got["a/x"] == ("MIT", "file", None) and got["a/y.py"] == ("MIT", "inherited", "a") and got["b/1"][1] == "none"
