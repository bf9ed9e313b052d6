import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cmdspark.functions import batches
from cmdspark.functions.html import page_fields
from cmdspark.jobs import manual_jobs, source_jobs
from cmdspark.operators import manual, rules
from cmdspark.sources import manuals, models

from .compare import TABLES, assert_same

PAGE = """<html data-mc-toc-path="Ref|Commands|ATPG"><head><script>x('<p>no</p>')</script></head><body>
<nav class="related-links"><a href="man_run_drc.htm">d</a><a href="man_add_faults.htm">f</a><a href="other.htm">o</a><a href="man_run_drc.htm">d</a></nav>
<h1> run <b>atpg</b> </h1><div class="x short-description">Short &amp; sweet</div><p>tiny<p>A paragraph that is long enough
<div class="syntax"><pre>run_atpg
   [-auto ]
   [-n <b>count</b> ]</pre></div>
<div class="arguments"><dl><dt>-auto<dd>Automatic<dt> -n count<dd>Number<dt>plain<dd>none<dt>-n again<dd>Last</dl><ul><li>one<li>two</ul></div>
<div class="description">Use set_atpg and run_atpg, then report_faults.</div>
<div class="example"><pre>run_drc x</pre><p>then run_atpg</p></div></body></html>"""


def test_page(spark):
    pages = spark.createDataFrame([("/m/man_run_atpg.htm", PAGE), ("man_empty.htm", ""), ("man_null.htm", None)], "path string, html string")
    r = {x["command"]: x for x in manual.parse_pages(pages).collect()}
    p = r["run_atpg"]
    assert p["category"] == "ATPG"
    assert p["title"] == "run atpg"
    assert p["syntax"] == "run_atpg [-auto] [-n count]"
    assert p["options"] == {"-auto": "Automatic", "-n": "Last"}
    assert p["options_text"] == "-auto : Automatic\n-n count : Number\nplain : none\n-n again : Last\none\ntwo"
    assert p["first_paragraph"].startswith("A paragraph")
    assert p["related"] == ["add_faults", "run_drc"]
    assert p["depends_on"] == ["report_faults", "run_drc", "set_atpg"]
    assert p["description"].startswith("Use set_atpg")
    assert p["examples_flat"] == "run_drc x"
    assert r["empty"]["error"] is None
    assert r["empty"]["description"] == ""
    assert r["null"]["error"] == "no page"


LAYOUT = """<html data-mc-toc-path="Ref|DRC"><body><div class="lead short-description">Short</div><span class="syntax-section"><pre>not this</pre></span>
<div class="c syntax-section">Syntax<pre>run_drc
  [-a | -b ]</pre></div>
<div class="arguments-section"><dl><dt>-a n</dt><!-- x --><dt>-<b>b</b></dt><dd>both</dd><dt>-c</dt></dl></div>
<div class="description-section">See set_drc.</div><div class="example-section">One<pre>report_drc</pre></div></body></html>"""


def test_page_in_a_manuals_layout(spark):
    """The full description isn't taken for the short one, and terms share the next definition."""
    p = manual.parse_pages(spark.createDataFrame([("man_run_drc.htm", LAYOUT)], "path string, html string")).first()
    assert p["description"] == "See set_drc."
    assert p["depends_on"] == ["report_drc", "set_drc"]
    assert p["syntax"] == "run_drc [-a | -b]"
    assert p["options"] == {"-a": "both", "-b": "both", "-c": ""}
    assert p["options_text"] == "-a n : both\n- b : both\n-c : "
    assert (p["examples"], p["examples_flat"]) == ("One\nreport_drc", "report_drc")
    without = LAYOUT.replace("description-section", "other")
    assert manual.parse_pages(spark.createDataFrame([("man_run_drc.htm", without)], "path string, html string")).first()["description"] == "Short"


def test_unclosed_paragraphs_end_where_the_next_begins():
    assert page_fields("<p>one<p>two<ul><li>a<li>b</ul>")["paragraphs"] == ["one", "two"]


def test_sections_round_trip(spark, tmp_path):
    r = spark.createDataFrame([("c1", "T", "D one\nD two", "", "-a : x", "e"), ("c2", "", "", "c2 [-a]", "", "")], "command string, title string, description string, syntax string, options string, examples string")
    manuals.write_section_text(r, str(tmp_path / "s"))
    back = {x["path"].split("command=")[1].split("/")[0]: x for x in manuals.read_sections(spark, str(tmp_path / "s") + "/*").collect()}
    assert back["c1"]["description"] == "D one\nD two"
    assert back["c1"]["syntax"] == ""
    assert back["c2"]["syntax"] == "c2 [-a]"


def test_graph_and_model(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"commands": {"a": {"category": "x", "syntax": "a", "options": {"-f": "d"}, "description": "", "examples": "", "related": [], "depends_on": ["a", "b"]}}, "categories": {"x": ["a"]}}')
    graph = models.load_graph_json(spark, str(tmp_path / "g.json")).collect()
    assert graph[0]["depends_on"] == ["b"]
    assert graph[0]["options"] == {"-f": "d"}
    models.write_model({"frequency": spark.createDataFrame([("a", 1)], "command string, count long")}, str(tmp_path / "m"))
    model = models.load_model(spark, str(tmp_path / "m"))
    assert model["frequency"].count() == 1
    assert model["transitions"].count() == 0


def test_html_source_drops_bad_bytes(spark, tmp_path):
    (tmp_path / "man_a.htm").write_bytes(b"<h1>a\xff</h1>")
    (tmp_path / "other.htm").write_bytes(b"x")
    rows = manuals.read_html(spark, str(tmp_path)).collect()
    assert [r["html"] for r in rows] == ["<h1>a</h1>"]


def test_pages_of_many_scripts_and_nested_navigation():
    page = "<html><nav><a href='man_a.htm'>a</a><nav class='related-links'><a href='man_b.htm'>b</a><script>x</script></nav></nav>" + "<script>var x = 1;</script><style>p {}</style>" * 20_000 + "<h1>t<script>no</script></h1><p>kept</p></html>"
    began = time.perf_counter()
    fields = page_fields(page)
    assert time.perf_counter() - began < 3
    assert (fields["hrefs"], fields["title"], fields["paragraphs"], fields["error"]) == (["man_b.htm"], "t", ["kept"], None)
    outer = page_fields("<nav class='related-links'><a href='man_a.htm'>a</a><nav><a href='man_b.htm'>b</a></nav></nav><nav><a href='man_c.htm'></a></nav>")
    assert outer["hrefs"] == ["man_a.htm", "man_b.htm"]


CUT = """<html lang="de"><head><title>x</title></head><body><header><nav><ul><li><a href="/Ab.htm">Ab &amp; c</a></li><li><a href="/Bd">d &lt</a></li></ul></nav></header>
<article><h1>one &lt; two &copy &am &amp</h1><p>A paragraph &gt that is long enough &amp</p><p>x &quot;de&quot; y &copy;</p></article><div class="ad">Buy &amp</div><footer>f</footer></body></html>"""


@pytest.mark.parametrize("name", ["m1_pages", "m4_titles", "s1_page_files", "s2_sections", "s6_section_files"])
def test_references_that_were_cut_off_are_text(spark, sf_dir, tmp_path, name):
    for t in TABLES:
        (tmp_path / f"{t}.parquet").symlink_to(f"{sf_dir}/{t}.parquet")
    (tmp_path / "pages.parquet").unlink()
    # the SQL of m1 reads a title's quotes in the description, of which it is part, but not in the title
    html = CUT if name == "m1_pages" else CUT.replace("two", "&quot;two&gt;")
    spark.createDataFrame([(n, "u", html) for n in (4, 5)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    jobs = manual_jobs if name in manual_jobs.QUERIES else source_jobs
    assert_same(jobs.QUERIES[name](spark, str(tmp_path)), jobs.SQL[name], str(tmp_path))


def test_titles_of_whole_records_have_the_references_that_sql_reads(spark, sf_dir, tmp_path):
    """The SQL of m1 leaves a quote's reference in the title and reads it in the description, of which the title is part."""
    for t in TABLES:
        (tmp_path / f"{t}.parquet").symlink_to(f"{sf_dir}/{t}.parquet")
    (tmp_path / "pages.parquet").unlink()
    pages = [(4, CUT.replace("two", "&quot;two&gt; &amp; de the")), (5, CUT.replace("one", "&quot;one")), (6, CUT.replace("<h1>one", "<h2>").replace("</h1>", "</h2>"))]
    spark.createDataFrame([(n, "u", html) for n, html in pages], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert_same(manual_jobs.m1_pages(spark, str(tmp_path)), manual_jobs.SQL["m1_pages"], str(tmp_path))


RECORD = "command string, title string, description string, syntax string, options string, examples string"


def test_section_texts_of_one_command_are_files_of_their_own(spark, tmp_path):
    """Records of one command, equal ones too, are all read back, and folders have the names that Spark gives."""
    rows = [("c", t, "", "", "", "") for t in ("T", "U", "T")] + [(c, "V", "", "", "", "") for c in ("a/b=c %é'", "{d}", "x y", "", None)]
    records = spark.createDataFrame(rows, RECORD).coalesce(1)
    manuals.write_section_text(records, f"{tmp_path}/own folder")
    back = manuals.read_section_folders(spark, f"{tmp_path}/own folder").collect()
    assert sorted((r["command"], r["title"]) for r in back) == sorted((r[0] or "", r[1]) for r in rows)
    manuals.section_text(records).write.partitionBy("command").text(f"{tmp_path}/spark")
    assert {x.name for x in (tmp_path / "own folder").iterdir()} == {x.name for x in (tmp_path / "spark").iterdir() if x.is_dir()}
    assert manuals.read_sections(spark, f"{tmp_path}/own folder/*").count() == len(rows)


def test_section_folders_are_replaced_whole(spark, tmp_path):
    folder = f"file://{tmp_path}/s"
    old, new = (spark.createDataFrame([(c, "T", "", "", "", "") for c in x], RECORD) for x in ("ab", "bc"))
    manuals.write_section_text(old, folder)
    with pytest.raises(Exception, match="lost"):
        manuals.write_section_text(new.withColumn("title", F.raise_error(F.lit("lost")).cast("string")), folder)
    assert {r["command"] for r in manuals.read_section_folders(spark, folder).collect()} == set("ab")
    manuals.write_section_text(manuals.read_section_folders(spark, folder).unionByName(new.withColumn("path", F.lit(""))).drop("path"), folder)
    assert sorted(r["command"] for r in manuals.read_section_folders(spark, folder).collect()) == list("abbc")
    manuals.write_section_text(new.limit(0), folder)
    assert manuals.read_section_folders(spark, folder).count() == 0
    assert [x.name for x in tmp_path.iterdir()] == ["s"]


def test_section_folders_where_arrow_does_not_know_the_file_system(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(manuals, "_known", lambda path: None)
    manuals.write_section_text(spark.createDataFrame([(c, "T", "", "", "", "") for c in "ab"], RECORD), f"{tmp_path}/s")
    assert {(r["command"], r["title"]) for r in manuals.read_section_folders(spark, f"{tmp_path}/s").collect()} == {("a", "T"), ("b", "T")}


def test_section_texts_are_plain_or_packed(spark, tmp_path):
    records = spark.createDataFrame([(c, "T" * 5000 + "é", "", "", "", c) for c in "ab"], RECORD)
    for compression, ending in ((None, ".txt"), ("gzip", ".txt.gz")):
        folder = f"{tmp_path}/{compression}"
        manuals.write_section_text(records, folder, compression)
        files = [x for x in (tmp_path / str(compression)).glob("*/*")]
        assert len(files) == 2
        assert all(x.name.endswith(ending) and (x.stat().st_size < 500) == (compression == "gzip") for x in files)
        for back in (manuals.read_section_folders(spark, folder), manuals.read_sections(spark, f"{folder}/*")):
            assert {(r["command"], r["title"], r["examples"]) for r in back.collect()} == {(c, "T" * 5000 + "é", c) for c in "ab"}
    with pytest.raises(ValueError, match="gzip"):
        manuals.write_section_text(records, folder, "lz4")


def test_many_section_folders_take_a_task_little_time(spark, tmp_path):
    records = spark.range(1500).select(F.concat(F.lit("c"), "id").alias("command"), *[F.lit("x").alias(c) for c in ("title", "description", "syntax", "options", "examples")]).coalesce(1)
    began = time.perf_counter()
    manuals.write_section_text(records, f"{tmp_path}/s")
    assert time.perf_counter() - began < 8
    assert manuals.read_section_folders(spark, f"{tmp_path}/s").select("command").distinct().count() == 1500


def test_few_rows_are_python_values_at_a_time():
    batch = pa.RecordBatch.from_pydict({"html": ["x" * 100_000] * 3000, "n": list(range(3000))})
    parts = list(batches.pieces(batch, "html"))
    assert max(p.column("html").nbytes for p in parts) <= 2 * batches.PIECE_BYTES
    assert [n for p in parts for n in p.column("n").to_pylist()] == list(range(3000))
    assert max(p.num_rows for p in batches.pieces(batch, "n")) <= batches.PIECE_ROWS


def test_syntaxes_of_one_file_are_read_by_many_tasks(spark):
    syntaxes = spark.createDataFrame([(str(n), f"c{n} [-a] <x | y>") for n in range(400)], "command string, syntax string").coalesce(1)
    ruled = rules.with_rules(syntaxes)
    assert ruled.select(F.spark_partition_id().alias("p")).distinct().count() == 4
    assert ruled.filter("rules.status = 'ok'").select("command").distinct().count() == 400


def test_graph_files_are_read_once(spark, tmp_path):
    (tmp_path / "g.json").write_text('{\n "commands": {\n  "a": {"category": "x"}\n },\n "categories": {\n  "x": ["a"]\n }\n}')
    for part in models.load_graph_file(spark, f"file://{tmp_path}/g.json"):
        assert "command_graph" not in part._jdf.queryExecution().optimizedPlan().toString()
        assert part.count() == 1
