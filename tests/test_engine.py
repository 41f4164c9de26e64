"""Sources, layout, reports, contracts, meaning, command line and streams."""

import json
import lzma
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from tabsight import cli
from tabsight.operators import model, rules, semantics, tables, versions
from tabsight.plans.profiler import Profiler
from tabsight.sinks import cleaning, reports
from tabsight.sources import layout, readers, xlsx
from tabsight.streaming import profiles

CSV = "id;name;amount;day\n1;Ana;10.5;2024-01-01\n2;Bia;7.25;2024-01-02\n00;N/A;3;2024-01-05\n"


@pytest.fixture
def csv(tmp_path):
    p = tmp_path / "people.csv"
    p.write_text(CSV)
    return p


def test_text_table(spark, csv):
    t = readers.load_table(spark, str(csv))
    assert t.name == "people" and t.layout.separator == ";" and dict(t.df.dtypes) == {"id": "string", "name": "string", "amount": "double", "day": "timestamp_ntz"}
    assert t.df.count() == 3


def test_packed_text(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("a.csv", CSV)
    (tmp_path / "b.csv.xz").write_bytes(lzma.compress(CSV.encode("cp1252")))
    assert readers.load_table(spark, str(tmp_path / "b.csv.xz"), scratch=str(tmp_path)).df.count() == 3
    with zipfile.ZipFile(tmp_path / "c.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.csv", "0" * 10_000_000)
    with pytest.raises(readers.FileFormatError):
        readers.check_zip((tmp_path / "c.zip").read_bytes())
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("a.csv", CSV)
        z.writestr("b.csv", CSV)
    with pytest.raises(readers.FileFormatError):
        readers.check_zip((tmp_path / "d.zip").read_bytes())
    assert readers.check_zip((tmp_path / "a.zip").read_bytes()).filename == "a.csv"


def test_preamble_and_totals(spark, tmp_path):
    p = tmp_path / "sheet.csv"
    rows = "\n".join(f"{i},item {i},{i * 2}" for i in range(1, 31))
    p.write_text(f"Report of sales,,\n,,\ncode,label,amount\n{rows}\nTOTAL,,{sum(i * 2 for i in range(1, 31))}\n")
    t = readers.load_table(spark, str(p))
    assert t.layout.header_row == 2 and t.layout.footer_rows == 1 and t.df.count() == 30 and dict(t.df.dtypes)["amount"] == "bigint"


def test_workbook(spark, tmp_path):
    p = tmp_path / "book.xlsx"
    p.write_bytes(xlsx.write_workbook({"one": [["code", "label", "group"], *([i, f"x{i}", "g" if i % 10 == 1 else None] for i in range(1, 41))], "two": [["a", "b"], [1, 2]]}))
    t = readers.load_table(spark, str(p))
    assert t.df.count() == 40 and dict(t.df.dtypes)["code"] == "bigint" and any("other sheets" in w for w in t.layout.warnings)
    assert readers.load_table(spark, str(p), sheet="two", detect_layout=False).df.count() == 1
    with pytest.raises(readers.IngestionError):
        readers.load_table(spark, str(p), sheet=9)
    with pytest.raises(readers.FileFormatError):
        readers.load_table(spark, str(tmp_path / "old.xls"))


def test_separators_encodings_labels():
    assert readers.sniff_separator(["a|b|c", '1|"x|y"|3']) == "|" and readers.sniff_separator(["abc", "def"]) == ","
    assert readers.detect_encoding("ação".encode()) == "utf-8" and readers.detect_encoding("informação não é útil àquela região".encode("cp1252")) != "utf-8"
    assert layout.unique_labels(["a", None, "a", "a"]) == ["a", "Unnamed: 1", "a.1", "a.2"]


def test_forward_fill_and_blocks(spark):
    rows = [(i, "g" + str(i // 10) if i % 10 == 0 else None, i) for i in range(40)]
    df = spark.createDataFrame(rows, "_row long, g string, v long")
    assert layout.merged_columns(df) == ["g"]
    assert [r["g"] for r in layout.forward_fill(df, ["g"]).orderBy("_row").collect()] == [f"g{i // 10}" for i in range(40)]
    blocks = spark.createDataFrame([(0, "a"), (1, None), (2, "b"), (3, None)], "_row long, x string")
    assert layout.multiple_blocks(blocks) == 1


def test_databases(spark, tmp_path):
    with sqlite3.connect(tmp_path / "s.db") as c:
        c.execute("CREATE TABLE sales (id INTEGER, value REAL)")
        c.executemany("INSERT INTO sales VALUES (?, ?)", [(1, 2.5), (2, 3.5)])
    t = readers.load_query(spark, f"sqlite:///{tmp_path}/s.db", "SELECT * FROM sales")
    assert t.df.agg(F.sum("value")).first()[0] == 6.0 and t.name == "query_s"
    import duckdb

    with duckdb.connect(str(tmp_path / "d.db")) as c:
        c.sql("CREATE TABLE t AS SELECT 1 AS a")
    assert readers.load_query(spark, f"duckdb:///{tmp_path}/d.db", "WITH x AS (SELECT * FROM t) SELECT * FROM x").df.count() == 1
    with pytest.raises(readers.IngestionError):
        readers.load_query(spark, f"sqlite:///{tmp_path}/s.db", "DELETE FROM sales")


def test_discovery_and_limit(spark, csv):
    (csv.parent / "note.txt").write_text("x")
    (csv.parent / "x.bin").write_text("x")
    assert [p.rsplit("/", 1)[1] for p in readers.discover(spark, str(csv.parent))] == ["people.csv"]
    t = readers.load_table(spark, str(csv), row_limit=2)
    assert t.df.count() == 2 and t.original_rows == 3 and "2 of 3" in t.sample_reason


@pytest.fixture(scope="module")
def staff(spark):
    rows = [(i, f"Maria {chr(97 + i % 26)} Souza", f"m{i}@x.org", 1000.0 + i, "N/A" if i % 20 == 0 else ["RH", "rh", "TI"][i % 3], None, f"2024-0{i % 9 + 1}-10") for i in range(200)]
    return spark.createDataFrame(rows + rows[:10], "id_staff long, full_name string, email string, salary double, department string, nothing string, hired string")


@pytest.fixture(scope="module")
def payload(spark, staff):
    return Profiler(spark).profile(staff, "staff")


def test_profile(payload):
    by = {c["column"]: c for c in payload["columns"]}
    assert by["nothing"]["characteristic"] == "empty" and by["hired"]["logical_type"] == "text date" and by["email"]["pattern"] == "E-mail"
    assert by["id_staff"]["role"] == "identifier" and by["salary"]["primary"] == "money" and by["department"]["domain"] == "organization"
    assert payload["duplicates"]["n_extra"] == 10 and payload["exposure"]["level"] == "high"
    damage = {d["column"]: d for d in payload["damage"]}
    assert damage["nothing"]["damage"] == 1.0 and "sentinel" in damage["department"]["reasons"] and "spelling" in damage["department"]["reasons"]
    actions = {(r["column"], r["action"]) for r in payload["recommendations"]}
    assert ("nothing", "drop the empty column") in actions and ("hired", "cast the text to a date") in actions
    assert not any(t["column"] == "email" for t in payload["top_values"])


def test_profile_of_nothing(spark):
    with pytest.raises(ValueError):
        Profiler(spark).profile(spark.createDataFrame([], "a long"))


def test_reports(spark, payload, tmp_path):
    assert json.loads(reports.to_json(payload | {"x": float("nan")}))["x"] is None
    assert "## Recommendations" in reports.to_markdown(payload)
    page = reports.to_html(payload | {"insights": ["<script>"]})
    assert "&lt;script&gt;" in page and page.count("<svg") > 3
    assert "columns" in reports.to_parquet(spark, payload, str(tmp_path / "p"))
    assert xlsx.sheet_names(reports.dictionary([payload, payload])) == ["summary", "staff", "staff_1"]
    with pytest.raises(RuntimeError):
        reports.to_pdf(page)
    assert reports.safe_names(["a/b", "a b", "A_B"]) == ["a_b", "a_b_2", "A_B_3"]


def test_cleaning(staff, payload):
    done = cleaning.clean(staff, payload, "key")
    assert done.count() == 200 and "nothing" not in done.columns and dict(done.dtypes)["hired"] == "timestamp"
    assert done.where("department IN ('N/A', 'rh')").count() == 0 and done.where("email LIKE '%@%'").count() == 0
    compile(cleaning.script(payload, "a'; import os"), "script", "exec")
    assert staff.sparkSession.sql(cleaning.select_sql(payload, "staff").replace("`staff`", "(SELECT * FROM {t})"), t=staff).count() > 0
    assert "Table.Distinct" in cleaning.power_query(payload, "a.csv")


def test_hierarchy_and_rules(spark):
    assert tables.hierarchies([("a", "b", "direct"), ("b", "c", "direct"), ("a", "c", "direct"), ("c", "d", "equivalence")]) == [["a", "b", "c"]]
    t = spark.createDataFrame([(100.0 + i, 11.0, 89.0 + i) for i in range(30)], "gross double, discount double, net double")
    found = {r["target"]: r["formula"] for r in rules.arithmetic_derivation(t, t.columns).collect()}
    assert found["net"] == "gross - discount"
    assert {r["rule"] for r in rules.domain_rules(t, 2025).collect()} == {"0.0 <= discount", "discount <= gross"}


def test_contracts(spark, staff):
    c = versions.generate_contract(staff.drop("nothing"))
    same = versions.Contract.from_yaml(c.to_yaml())
    assert versions.approved(versions.validate_contract(staff, same))
    broken = staff.drop("email").withColumn("salary", F.col("salary") * 10).withColumn("department", F.lit("XX")).limit(50)
    kinds = {r["kind"] for r in versions.validate_contract(broken, same).collect()}
    assert {"missing column", "range", "domain", "volume"} <= kinds
    with pytest.raises(ValueError):
        versions.Contract.from_yaml("- a")
    assert not any("unique" in v for v in versions.generate_contract(staff, sampled=True).columns.values())


def test_history_limits(spark):
    assert versions.read_limits("min_score: 70")["min_score"] == 70.0
    for bad in ("other: 1", "min_score: x", "min_score: 101", "min_score: -1"):
        with pytest.raises(ValueError):
            versions.read_limits(bad)
    with pytest.raises(ValueError):
        versions.history_summary([("a", spark.range(1))])


def test_model(spark):
    people = spark.createDataFrame([(1000 + i, f"n{i}", ["x", "y"][i % 2]) for i in range(100)], "matricula long, nome string, setor string")
    courses = spark.createDataFrame([(i, f"c{i}") for i in range(20)], "cod_curso long, titulo string")
    done = spark.createDataFrame([(5000 + i, 1000 + (i * 7) % 125, i % 20, float(i % 10)) for i in range(500)], "id long, matricula long, cod_curso long, nota double")
    m = Profiler(spark).model({"people": people, "courses": courses, "done": done})
    links = {(r["src_table"], r["src_col"], r["dst_table"]): r for r in m["relationships"]}
    assert links["done", "matricula", "people"]["pct_orphans"] == 0.2 and ("done", "cod_curso", "courses") in links
    assert {r["table"]: r["role"] for r in m["tables"]} == {"people": "dimension", "courses": "dimension", "done": "fact"}
    assert any("AVG(`nota`)" in a["sql"] for a in m["analyses"]) and "erDiagram" in reports.model_markdown(m)
    assert model.key_order(["ano", "mes"], ["mes", "ano"]) == [("mes", "mes"), ("ano", "ano")]


def test_vocabulary():
    c = semantics.Context.from_yaml("roles: {weight: [peso]}\ncorrections: {x9: money}")
    assert semantics.conclude("x9", [], {"n_distinct": 5, "uniqueness": 0.1}, c)["primary"] == "money"
    assert semantics.combine(semantics.name_evidence("peso", c))["role"][0][0] == "weight"
    with pytest.raises(ValueError):
        semantics.Context.from_yaml("colours: {}")
    assert semantics.tokens("dtAdmissaoCLT2") == ["dt", "admissao", "clt", "2"]


def test_command_line(spark, csv, tmp_path, capsys):
    out = str(tmp_path / "out")
    assert cli.main(["--out", out, "contract", str(csv)], spark) == 0
    assert cli.main(["--out", out, "validate", str(csv), f"{out}/people.contract.yaml"], spark) == 0
    csv.write_text(CSV.replace(";day", ";date"))
    assert cli.main(["--out", out, "validate", str(csv), f"{out}/people.contract.yaml"], spark) == 1
    assert cli.main(["--out", out, "profile", str(csv), "--format", "nope"], spark) == 2
    assert cli.main(["version"], spark) == 0
    rows = Profiler(spark).batch([str(csv), str(tmp_path / "missing.csv")])
    assert [r["error"] is None for r in rows] == [True, False]


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = profiles.profile_batches(stream, str(tmp_path / "out"), str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {r["column"]: r["n_rows"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["event_id"] == events.count()
    w = profiles.windowed_measure(stream, "ts", "value")
    q = w.writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("SELECT sum(n) FROM w").first()[0] == events.count()


def test_similar_names_do_not_depend_on_the_size_of_the_block(spark):
    import random
    from itertools import combinations

    from tabsight.functions.similarity import token_sort_ratio
    from tabsight.operators import duplicates

    r = random.Random(4)
    names = sorted({" ".join(["a" + "".join(r.choice("abcdefgh") for _ in range(6)), "maria oliveira pereira", r.choice(["souza", "sousa", "souzo"])]) for _ in range(450)})
    expected = {(a, b) for a, b in combinations(names, 2) if token_sort_ratio(a, b) >= 92 and len(a) // 4 == len(b) // 4}
    table = spark.createDataFrame([(x,) for x in names], "name string")
    for most in (400, 50, 10_000):
        got = [(x["name_a"], x["name_b"]) for x in duplicates.similar_names(table, "name", most_in_block=most).collect()]
        assert len(got) == len(set(got)) and set(got) == expected


def test_shapes_of_personal_data_and_of_dates_as_text_are_not_judged(spark):
    from tabsight.operators import quality

    rows = [(f"Customer{i}@mail.org", f"C-{i % 90:02d}" if i % 9 else "odd", f"1995-03-{i % 28 + 1:02d}" + ("" if i % 9 else " 00:00")) for i in range(20, 120)]
    got = quality.recommendations(spark.createDataFrame(rows, "email string, code string, day string"), "people").where("action = 'check values of another shape'")
    assert [r["column"] for r in got.collect()] == ["code"]


def test_name_classes_hold_all_links_of_similar_names(spark):
    import random
    from itertools import combinations

    from tabsight.functions.similarity import near_texts, token_sort_ratio
    from tabsight.operators import duplicates

    r = random.Random(6)
    words = ["".join(r.choice("abc") for _ in range(r.randint(1, 9))) for _ in range(60)]
    odd = sorted({" ".join(sorted(r.choice(words) for _ in range(r.randint(2, 5)))) for _ in range(500)})
    got = {(i, j): x for a, b, s in near_texts([v.encode() for v in odd], [v.encode() for v in odd], 80.0) for i, j, x in zip(a.tolist(), b.tolist(), s.tolist(), strict=True)}
    near = lambda a, b: 85 * len(b) <= 100 * len(a) <= 118 * len(b)
    assert got == {(i, j): token_sort_ratio(a, b) for i, a in enumerate(odd) for j, b in enumerate(odd) if near(a, b) and token_sort_ratio(a, b) >= 80}

    names = sorted({f"a{r.randrange(10**4)} maria {''.join(r.choice('bcde') for _ in range(6))} oliveira pereira" for _ in range(300)}) + ["Ana", "zoe lima souza"]
    key = {n: " ".join(sorted(n.lower().split())) for n in names}
    strip = lambda v: "".join(c for c in v if not c.isdigit())
    links = [(a, b) for a, b in combinations(key.values(), 2) if min(len(a), len(b)) >= 8 and a[0] == b[0] and len(a) // 4 == len(b) // 4 and near(a, b) and token_sort_ratio(a, b) >= 92 and strip(a) != strip(b)]
    count, root = dict.fromkeys(key.values(), 0), {v: v for v in key.values()}
    for a, b in links:
        count[a], count[b] = count[a] + 1, count[b] + 1
    for _ in names:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert len(links) > 50
    table = spark.createDataFrame([(x,) for x in [*names, names[0], None]], "name string")
    for most in (1 << 13, 70):
        got = duplicates.name_classes(table, "name", most_in_block=most).collect()
        assert sorted(map(tuple, got)) == sorted((n, k, root[k], count[k]) for n, k in key.items())
