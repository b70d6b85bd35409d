"""Pages, boards, uploads, gates and restarts, by example."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from vacantia.functions import providers
from vacantia.operators import artifacts, features
from vacantia.sources import boards, files, pages


def test_tree_of_odd_pages():
    assert pages.Tree("").texts() == ([], "")
    nodes, body = pages.Tree("<p>a<div class='x job-description'>b<br>c<script>no</script></div></b></p><main>d <select><option>no</select>e").texts()
    assert nodes == ["b\nc", "b\nc", "d\ne"] and body == "a\nb\nc\nd\ne"
    assert pages._braces("initialState: {a: {b: 1}} tail }") == "{a: {b: 1}}" and pages._braces("initialState: {") is None


def test_posting_in_lists_and_graphs():
    assert pages._posting([{"@graph": [[{"@type": ["A", "JobPosting"], "x": 1}]]}])["x"] == 1
    assert pages._posting({"@type": "Other"}) is None


def test_pages_of_listings():
    seen = []

    def fetch(source, at, size):
        seen.append((at, size))
        if size > 20:
            return 413, None
        return 200, '{"total": 45, "jobPostings": [' + ", ".join(f'{{"id": {k}}}' for k in range(at, min(at + size, 45))) + "]}"

    assert len(list(boards.offset_pages("s", fetch))) == 45 and seen == [(0, 100), (0, 20), (20, 20), (40, 20)]
    assert [j["id"] for j in boards.offset_pages("s", fetch, most=7)] == list(range(7))
    with pytest.raises(RuntimeError):
        list(boards.offset_pages("s", lambda *_: (500, None)))
    assert list(boards.numbered_pages("s", lambda *_: (200, "not json"))) == []


def test_entry_urls(spark):
    rows = [("icims", "", "https://c.icims.com/jobs"), ("workday", "x/Careers", "https://x.wd5.myworkdayjobs.com/Careers"), ("workday", "", "https://x.wd5.myworkdayjobs.com/"), ("lever", " a b/c~* ", "u"), ("adp", "", "u"), (None, None, None)]
    d = spark.createDataFrame(rows, "p string, i string, u string")
    got = [r[0] for r in d.select(providers.entry_url(F.col("p"), F.col("i"), F.col("u"))).collect()]
    assert got == [rows[0][2], rows[1][2], None, "https://api.lever.co/v0/postings/a%20b/c~%2A?mode=json", None, None]


def test_uploads_and_hash(spark, tmp_path):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:r><w:t>Five </w:t><w:t>years</w:t></w:r></w:p><w:p><w:t>of SQL</w:t></w:p></w:document>')
    rows = [("a.docx", out.getvalue()), ("b.md", b"plain \n  text"), ("c.docx", b"broken"), ("d.exe", b"x"), ("e.txt", b"\xff")]
    got = {r["path"]: r["text"] for r in files.uploaded_text(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got == {"a.docx": "Five years of SQL", "b.md": "plain text", "c.docx": None, "d.exe": None, "e.txt": None}
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "r.md").write_text("one")
    first = files.dataset_hash(spark, str(tmp_path))
    (tmp_path / "sub" / "r.md").write_text("two")
    assert len(first) == 64 and files.dataset_hash(spark, str(tmp_path)) != first


def test_limits_gates_and_steps(spark):
    d = spark.createDataFrame([(1, b"abc"), (2, b"abcdef")], "k int, content binary")
    assert [r["k"] for r in files.within_limit(d, "content", 3).collect()] == [1]
    with pytest.raises(Exception, match="over 3 bytes"):
        files.within_limit(d, "content", 3, strict=True).collect()
    assert artifacts.require_columns(d, "k int") is d
    with pytest.raises(ValueError, match="k bigint, z string"):
        artifacts.require_columns(d, "k bigint, z string")

    def fail():
        raise TimeoutError

    assert artifacts.run_or_skip({"a": lambda: 1, "b": fail, "c": lambda: 2}, {"b"}, (TimeoutError,)) == {"a": "ok", "b": "skipped", "c": "ok"}
    with pytest.raises(TimeoutError):
        artifacts.run_or_skip({"b": fail}, set(), (TimeoutError,))
    with pytest.raises(TimeoutError):
        artifacts.run_or_skip(dict.fromkeys("wxyz", fail), set("wxyz"), (TimeoutError,))


def test_rows_that_do_not_align_raise(spark):
    m = spark.createDataFrame([(0, 0, "a"), (0, 1, "b")], "artifact_shard int, row_index int, title string")
    v = spark.createDataFrame([(0, 0, [1.0])], "artifact_shard int, row_index int, vector array<double>")
    assert artifacts.by_row(m, v, most=1).count() == 1
    with pytest.raises(Exception, match="not aligned"):
        artifacts.by_row(m, v).collect()


def test_technologies_spelled_in_many_ways(spark):
    terms = [("Node.js", "Web"), ("C++", "Languages"), ("Ruby on Rails", "Web"), ("CI/CD", "Tools"), ("Go", "Languages"), (".NET", "Web"), ("React Native", "Mobile"), ("React", "Web")]
    rows = [(1, "We use node.js, C++ and Ruby on rails"), (2, "CI/CD with React Native; going well"), (3, "a go/no-go .NET shop"), (4, None), (5, "nodejs rubyonrails reacts")]
    got = {r["k"]: r["technologies"] for r in features.technologies(spark.createDataFrame(rows, "k int, t string"), "k", "t", terms).collect()}
    assert got == {1: ["C++", "Node.js", "Ruby on Rails"], 2: ["CI/CD", "React", "React Native"], 3: [".NET", "Go"], 4: [], 5: ["Node.js", "Ruby on Rails"]}
    assert features.technologies(spark.createDataFrame(rows, "k int, t string"), "k", "t", []).first()["categories"] == []
