"""Statements whose names must, and must not, be found."""

import pytest

from provsight.functions import text as T
from provsight.operators import tokens

CASES = {
    "cte": ("INSERT INTO A.T WITH c AS (SELECT x FROM B.S) SELECT x FROM c JOIN D.U u ON u.k = c.k", {("from", "B", "S"), ("join", "D", "U"), ("insert", "A", "T")}),
    "comma": ("SELECT 1 FROM A.T t, B.S s, C.U WHERE t.k = s.k", {("from", "A", "T"), ("comma", "B", "S"), ("comma", "C", "U")}),
    "derived": ("SELECT d.x FROM (SELECT x FROM A.T) d", {("from", "A", "T")}),
    "merge": ("MERGE INTO A.T t USING (SELECT k FROM B.S) s ON t.k = s.k WHEN MATCHED THEN UPDATE SET v = 1", {("merge", "A", "T"), ("from", "B", "S")}),
    "using": ("MERGE INTO A.T t USING B.S s ON t.k = s.k", {("merge", "A", "T"), ("from", "B", "S")}),
    "system": ("SELECT 1 FROM DBC.TablesV JOIN A.T ON 1 = 1", {("join", "A", "T")}),
    "extract": ("SELECT EXTRACT(YEAR FROM a.dt) FROM A.T", {("from", "A", "T")}),
    "noise": ("SELECT 'FROM X.Y' FROM A.T -- FROM X.Z\n/* JOIN X.W */", {("from", "A", "T")}),
    "self": ("REPLACE VIEW A.V AS SELECT * FROM a.v JOIN B.S ON 1 = 1", {("join", "B", "S")}),
    "delete": ("DELETE FROM A.T", {("delete", "A", "T")}),
    "call": ("CALL A.P(1)", {("call", "A", "P")}),
    "fk": ("CREATE TABLE A.T (k INT REFERENCES B.S (k))", {("foreign_key", "B", "S")}),
    "null": (None, set()),
    "empty": ("", set()),
}


@pytest.mark.parametrize("name", CASES)
def test_references(spark, name):
    text, want = CASES[name]
    df = spark.createDataFrame([(1, text)], "id long, body string")
    assert {tuple(r) for r in T.extract_refs(df, "id").select("anchor", "ref_db", "ref_name").collect()} == want


def test_merge_needs_two_privileges(spark):
    df = spark.createDataFrame([(1, CASES["merge"][0])], "id long, body string")
    assert {(r.intent, r.ref_name, r.privilege) for r in T.extract_intents(df, "id").collect()} == {("write", "T", "INSERT"), ("write", "T", "UPDATE"), ("read", "S", "SELECT")}


def test_mask_keeps_length_and_lines(spark):
    text = "a 'x--y' -- c'd\n/* e\nf */ g ''''"
    got = spark.createDataFrame([(text,)], "t string").select(T.mask_same_length(__import__("pyspark").sql.functions.col("t"))).first()[0]
    assert len(got) == len(text) and got.count("\n") == 2 and got.split() == ["a", "g"]


def test_split_keeps_bodies(spark):
    df = spark.createDataFrame([(1, "CREATE PROCEDURE A.P() BEGIN x; y; END; SELECT ';' ;;")], "id long, text string")
    assert [r.statement for r in T.split_statements(df).orderBy("seq").collect()] == ["CREATE PROCEDURE A.P() BEGIN x; y; END", "SELECT ';'"]


def test_contract(spark):
    rows = [(1, "CREATE TABLE A.T (K INTEGER NOT NULL, \"N\" DECIMAL(5,2), PRIMARY KEY (K))"), (2, "REPLACE VIEW A.V (a, B) AS SELECT 1, 2"), (3, "REPLACE VIEW A.W AS SELECT 1"), (4, "CREATE PROCEDURE A.P (OUT x INTEGER, y CHAR(3))"), (5, None)]
    got = {(r.id, r.pos, r.name, r.direction) for r in T.extract_contract(spark.createDataFrame(rows, "id long, body string")).collect()}
    assert got == {(1, 0, "k", None), (1, 1, "n", None), (2, 0, "a", None), (2, 1, "b", None), (4, 0, "x", "OUT"), (4, 1, "y", "IN")}


def test_circular_values_are_reported(spark):
    rows = [("e", "A", "{{B}}"), ("e", "B", "{{A}}"), ("e", "C", "x{{D}}"), ("e", "D", "d"), ("e", "S", "a{{S}}{{D}}"), ("e", "T", "t{{S}}"), ("m", "Y", "{{{{B}}}}"), ("m", "B", "Y"), ("m", "Z", "{{Y}}")]
    got = {r.token: (r.value, r.unresolved) for r in tokens.resolve_values(spark.createDataFrame(rows, "env string, token string, value string")).collect()}
    assert got["C"] == ("xd", False) and got["D"] == ("d", False) and got["S"] == ("a{{S}}d", False) and got["T"] == ("t{{S}}", True)
    assert got["A"] == ("{{B}}", True) and got["B"] == ("{{A}}", True)


def test_resolution_is_bounded(spark):
    """A loop of doubled references ends at once, chains of 300 resolve, and what would outgrow the bound keeps its text."""
    rows = [("l", a, f"{{{{{b}}}}}{{{{{b}}}}}") for a, b in ("AB", "BC", "CA")] + [("l", "D", "d {{A}} {{E}}"), ("l", "E", "e"), ("l", "F", "{{D}}{{NONE}}")]
    rows += [("c", f"N{k}", f"{{{{N{k - 1}}}}}." if k else "r") for k in range(300)]
    rows += [("g", f"G{k}", f"{{{{G{k - 1}}}}}{{{{G{k - 1}}}}}" if k else "") for k in range(60)] + [("g", "U", "{{G2}}-{{G59}}"), ("g", "V", "{{G3}}v")]
    rows += [("n", "X", None), ("n", "Y", "{{X}}y")]
    got = {(r.env, r.token): (r.value, r.unresolved) for r in tokens.resolve_values(spark.createDataFrame(rows, "env string, token string, value string"), max_chars=10_000).collect()}
    assert len(got) == len(rows)
    assert got["l", "A"] == ("{{B}}{{B}}", True) and got["l", "D"] == ("d {{A}} e", True) and got["l", "F"] == ("d {{A}} e{{NONE}}", True) and got["l", "E"] == ("e", False)
    assert all(got["c", f"N{k}"] == ("r" + "." * k, False) for k in range(300))
    assert got["g", "G10"] == ("", False) and got["g", "G40"] == ("{{G39}}{{G39}}", True) and got["g", "U"] == ("{{G2}}-{{G59}}", True) and got["g", "V"] == ("v", False)
    assert got["n", "X"] == (None, False) and got["n", "Y"] == ("{{X}}y", False)


def test_layers_wait_for_what_they_need(spark, monkeypatch):
    """Loops are looked for in the few values that are left inside; layers are replaced by what these came to, loops, long values and made references included."""
    looked, plain = [], tokens.strong_components
    monkeypatch.setattr(tokens, "strong_components", lambda edges: looked.append(edges.count()) or plain(edges))
    monkeypatch.setattr(tokens, "FEW", 8, raising=False)
    name = lambda *n: "".join(f"{{{{N{k}}}}}" for k in n)
    texts = {k: name(k // 2) + (name(k // 3, k // 2) if k % 5 == 0 else "") + f".{k}" if k > 2 else "r" if k == 1 else "{{N1}}s" for k in range(1, 100)}
    want = {}
    for k, text in texts.items():
        want[k] = text
        for n in (k // 2, k // 3):
            want[k] = want[k].replace(name(n), want[n] if n else name(n))
    run = lambda rows, **more: {(r.env, r.token): (r.value, r.unresolved) for r in tokens.resolve_values(spark.createDataFrame(rows, "env string, token string, value string"), **more).collect()}
    rows = [("t", f"N{k}", text) for k, text in texts.items()]
    assert run(rows) == {("t", f"N{k}"): (text, False) for k, text in want.items()}
    assert sum(looked) < 20
    rows = [("l", f"R{k}", f"{{{{R{(k + 1) % 3}}}}}") for k in range(3)] + [("l", f"H{k}", f"{{{{R{k % 3}}}}}h") for k in range(20)] + [("l", f"I{k}", f"{{{{H{k}}}}}i") for k in range(20)]
    rows += [("g", f"G{k}", f"{{{{G{k - 1}}}}}" * 2 if k else "ab") for k in range(8)] + [("g", f"K{k}", f"{{{{G{k % 8}}}}}k") for k in range(40)] + [("g", f"L{k}", f"{{{{K{k}}}}}" * 9) for k in range(40)]
    rows += [("o", "Y", "{{{{B}}}}"), ("o", "B", "Z"), ("o", "Z", "z{{Q}}"), ("o", "Q", "q"), ("o", "P", "{{{{{{{{{{Q}}}}}}}}}}"), ("o", "q", "q2"), ("o", "q2", "q3"), ("o", "q3", "q4"), ("o", "q4", "end"), ("s", "S", "{{S}}"), ("s", "T", "t{{S}}"), ("s", "U", "{{T}}")] + [("o", f"V{k}", "{{Y}}") for k in range(30)]
    got = run(rows, max_chars=200)
    assert len(got) == len(rows)
    assert all(got["l", f"R{k}"] == (f"{{{{R{(k + 1) % 3}}}}}", True) for k in range(3)) and all(got["l", f"I{k}"] == (f"{{{{R{k % 3}}}}}hi", True) for k in range(20))
    for k in range(40):  # G7 has 256 characters; K4 has 33, so nine of it are too long
        assert got["g", f"K{k}"] == (("ab" * 2 ** (k % 8) + "k", False) if k % 8 < 7 else ("{{G7}}k", True))
        assert got["g", f"L{k}"] == ((("ab" * 2 ** (k % 8) + "k") * 9, False) if k % 8 < 4 else (f"{{{{K{k}}}}}" * 9, True))
    assert got["o", "P"] == ("end", False)
    assert all(got["o", f"V{k}"] == ("zq", False) for k in range(30)) and got["s", "S"] == ("{{S}}", False) and got["s", "U"] == ("t{{S}}", True)


def test_a_value_is_not_replaced_in_its_turn(spark):
    df = spark.createDataFrame([(1, "x {{A}} {{B}} {{C}} {{A}}")], "id long, body string")
    tokens = spark.createDataFrame([("A", "{{B}}"), ("B", "$1 b")], "token string, value string")
    r = T.substitute_tokens(df, "id", tokens).first()
    assert (r.body, r.n_substituted, r.undefined) == ("x {{B}} $1 b {{C}} {{B}}", 3, "C")
    with pytest.raises(Exception, match="undefined tokens: C"):
        T.substitute_tokens(df, "id", tokens, strict=True).collect()


def test_system_databases_are_no_dependencies(spark):
    body = "REPLACE VIEW A.V AS SELECT * FROM SQLJ.X JOIN TD_SYSXML.Y JOIN SYSUIF.Z JOIN DBCMNGR.W JOIN SYSTEMFE.K"
    refs = T.extract_refs(spark.createDataFrame([(1, body)], "id long, body string"), "id").collect()
    assert {r.ref_db for r in refs} == {"SYSTEMFE"}


def test_registered_functions(spark):
    from provsight.functions import extractors

    extractors.register(spark)
    row = spark.sql(r"""SELECT mask_noise("a -- b\n'c;'") AS m, split_statements("x 'a;b'; y; BEGIN p; q; END;") AS s, mask_noise(NULL) AS n""").first()
    assert (row.m, row.s, row.n) == ("a     \n    ", ["x 'a;b'", "y", "BEGIN p; q; END"], None)


def test_statements_of_a_kind(spark):
    """The same rows that the whole classification gives, for the first kind and for one that others precede."""
    texts = ["REPLACE VIEW a.b AS SELECT 1", "/* CREATE VIEW */ CREATE TABLE a.t (k INT)", "CREATE JOIN INDEX a.j AS SELECT 1", "CREATE UNIQUE INDEX a.i", "DROP VIEW a.b", "x", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, body string")
    kinds = {r["k"]: r["kind"] for r in T.classify_statements(df).collect()}
    for kind in ("VIEW", "INDEX", "DROP"):
        assert sorted(r["k"] for r in T.of_kind(df, kind).collect()) == [k for k, v in kinds.items() if v == kind]


def test_stars_are_scanned_once(spark, tmp_path, monkeypatch):
    """Each text is scanned once, whatever reads the result; a star without edits is still counted."""
    seen, plain = str(tmp_path / "seen"), T.scan_stars

    def noted(text):
        with open(seen, "a") as out:
            out.write(f"{text}\n")
        return plain(text)

    monkeypatch.setattr(T, "scan_stars", noted)
    df = spark.createDataFrame([(1, "SELECT * FROM d.t"), (2, "SELECT * FROM d.none"), (3, "SELECT 1")], "k long, body string")
    columns = spark.createDataFrame([("d", "t", 2, "y"), ("D", "T", 1, "x"), ("d", "t", 2, "y")], "db string, name string, pos int, column string")
    got = sorted(map(tuple, T.expand_stars(df, "k", columns).collect()))
    assert got == [(1, "SELECT t.x, t.y FROM d.t", 1, 0), (2, "SELECT * FROM d.none", 0, 1), (3, "SELECT 1", 0, 0)]
    assert len(open(seen).read().split("\n")) - 1 == 3
