"""Text-corpus functions: a table of statements in, a table of what they hold out.

Everything here runs on a text column of any number of rows. Expressions are Spark's own; only what regular
expressions cannot express row by row (length-preserving masks, nesting-aware splits, column lists, positions)
is a vectorised pandas UDF.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, spread

#: A literal or a comment, whichever starts first: so a dash in a literal is no comment, and the reverse.
NOISE = r"'(?:[^']|'')*'|--[^\n]*|/\*(?s:.*?)\*/"
NAME = r'(?:"[^"]+"|[A-Za-z0-9_$#{}]+)'
QUALIFIED = rf"({NAME})\.({NAME})"
#: Databases of the server itself, to which references are no dependencies.
SYSTEM = ("DBC", "SYSLIB", "SYSUDTLIB", "SYSUIF", "TD_SYSFNLIB", "TD_SYSXML", "SQLJ", "SYSSPATIAL", "DBCMNGR")
#: These and other supplied names, which no rewriting touches.
SUPPLIED = (*SYSTEM, "SYSJDBC", "SYSBAR", "SYSTEMFE", "TDSTATS", "TDWM", "TD_SYSGPL", "ALL", "DEFAULT", "PUBLIC", "EXTUSER")


def mask_noise(text: Column) -> Column:
    """Literals and comments become one space: for extraction where positions do not matter."""
    return F.regexp_replace(text, NOISE, " ")


_noise = re.compile(NOISE)
_piece = re.compile(rf"{NOISE}|[();]|\b(?:BEGIN|END|CASE)\b", re.I)


def blank_noise(text: str) -> str:
    return _noise.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def mask_same_length(text: Column) -> Column:
    """Literals and comments become blanks of equal length; newlines stay, so offsets and lines hold."""
    return F.pandas_udf(lambda texts: texts.map(lambda t: None if t is None else blank_noise(t)), "string")(text)


def unquote(name: Column) -> Column:
    return F.regexp_replace(name, '"', "")


def split_text(source: str | None) -> list[str]:
    out, start, depth, block = [], 0, 0, 0
    for m in _piece.finditer(source or ""):
        token = m[0].upper()
        if token == "(":
            depth += 1
        elif token == ")":
            depth = max(0, depth - 1)
        elif token in ("BEGIN", "CASE"):
            block += 1
        elif token == "END":
            block = max(0, block - 1)
        elif token == ";" and not depth and not block:
            out.append(source[start : m.start()].strip())
            start = m.end()
    return [s for s in (*out, (source or "")[start:].strip()) if s]


def split_statements(df: DataFrame, text: str = "text") -> DataFrame:
    """(…, seq, statement): split at semicolons outside literals, comments, parentheses and BEGIN..END bodies."""
    parts = F.pandas_udf(lambda texts: texts.map(split_text), "array<string>")
    return df.select(*[c for c in df.columns if c != text], F.posexplode(parts(F.col(text))).alias("seq", "statement"))


#: First match decides. (type, pattern at the start of the masked statement)
KINDS = (
    ("VIEW", r"^\s*(?:CREATE|REPLACE)\s+(?:RECURSIVE\s+)?VIEW\b"),
    ("MACRO", r"^\s*(?:CREATE|REPLACE)\s+MACRO\b"),
    ("PROCEDURE", r"^\s*(?:CREATE|REPLACE)\s+PROCEDURE\b"),
    ("SCRIPT_TABLE_OPERATOR", r"^\s*(?:CREATE|REPLACE)\s+(?:SPECIFIC\s+)?FUNCTION\b(?s:.*?)TABLE\s+OPERATOR"),
    ("FUNCTION", r"^\s*(?:CREATE|REPLACE)\s+(?:SPECIFIC\s+)?FUNCTION\b"),
    ("TRIGGER", r"^\s*(?:CREATE|REPLACE)\s+TRIGGER\b"),
    ("JOIN_INDEX", r"^\s*CREATE\s+JOIN\s+INDEX\b"),
    ("HASH_INDEX", r"^\s*CREATE\s+HASH\s+INDEX\b"),
    ("INDEX", r"^\s*CREATE\s+(?:UNIQUE\s+)?INDEX\b"),
    ("TABLE", r"^\s*(?:CREATE|REPLACE)\s+(?:(?:MULTISET|SET|VOLATILE|GLOBAL\s+TEMPORARY|TRACE)\s+)*TABLE\b"),
    ("DATABASE", r"^\s*CREATE\s+DATABASE\b"),
    ("USER", r"^\s*CREATE\s+USER\b"),
    ("ROLE", r"^\s*CREATE\s+ROLE\b"),
    ("PROFILE", r"^\s*CREATE\s+PROFILE\b"),
    ("MAP", r"^\s*CREATE\s+MAP\b"),
    ("AUTHORIZATION", r"^\s*CREATE\s+AUTHORIZATION\b"),
    ("FOREIGN_SERVER", r"^\s*CREATE\s+FOREIGN\s+SERVER\b"),
    ("JAR", r"^\s*CALL\s+SQLJ\s*\.\s*(?:INSTALL_JAR|CREATE_JAR|REPLACE_JAR)\s*\("),
    ("GRANT", r"^\s*GRANT\b"),
    ("REVOKE", r"^\s*REVOKE\b"),
    ("STATISTICS", r"^\s*(?:COLLECT\s+STAT|UPDATE\s+STATISTICS\b)"),
    ("COMMENT", r"^\s*COMMENT\b"),
    ("FOREIGN_KEY", r"^\s*ALTER\s+TABLE\b(?s:.*?)\bADD\s+FOREIGN\s+KEY\b"),
    ("DROP", r"^\s*DROP\b"),
    ("DML", r"^\s*(?:INSERT|UPDATE|DELETE|MERGE|SELECT|CALL|EXEC)\b"),
)
#: Languages that a function or procedure names, and the subtype without one of them.
LANGUAGES = {"FUNCTION": (("FUNCTION_C", r"\bLANGUAGE\s+C\b(?!\+)"), ("FUNCTION_SQL", "")), "PROCEDURE": (("PROCEDURE_JAVA", r"\bLANGUAGE\s+JAVA\b"), ("PROCEDURE_CPP", r"\bLANGUAGE\s+(?:CPP\b|C\+\+)"), ("PROCEDURE_SPL", ""))}
#: The types that a file's extension promises; an extension that is not here promises none.
EXTENSIONS = {
    "tbl": ("TABLE",), "viw": ("VIEW",), "mcr": ("MACRO",), "spl": ("PROCEDURE",), "fnc": ("FUNCTION",), "trg": ("TRIGGER",), "jix": ("JOIN_INDEX",), "idx": ("INDEX", "HASH_INDEX"), "db": ("DATABASE",),
    "usr": ("USER",), "sjr": ("JAR",), "jar": ("JAR",), "cmt": ("COMMENT",), "cmnts": ("COMMENT",), "stt": ("STATISTICS",), "sto": ("SCRIPT_TABLE_OPERATOR",), "dcl": ("GRANT", "REVOKE"), "grt": ("GRANT", "REVOKE"),
    "grants": ("GRANT", "REVOKE"), "map": ("MAP",), "rol": ("ROLE",), "prf": ("PROFILE",), "auth": ("AUTHORIZATION",), "fsvr": ("FOREIGN_SERVER",), "dml": ("DML",), "fk": ("FOREIGN_KEY",),
}
INTENTS = {
    "migrate": ("TABLE",), "drop_create": ("INDEX", "JOIN_INDEX", "HASH_INDEX"), "skip_if_exists": ("DATABASE", "USER", "ROLE", "PROFILE", "MAP", "AUTHORIZATION", "FOREIGN_SERVER"),
    "run": ("GRANT", "REVOKE", "STATISTICS", "COMMENT", "DROP", "DML", "JAR", "FOREIGN_KEY"),
}


def classify(masked: Column, kinds=KINDS) -> Column:
    """The kind of a statement whose noise is masked. Give a column, not an expression: each pattern reads it again."""
    return F.coalesce(*[F.when(masked.rlike("(?i)" + p), F.lit(k)) for k, p in kinds], F.lit("UNKNOWN"))


def classify_statements(df: DataFrame, text: str = "body", kinds=KINDS, path: str | None = None) -> DataFrame:
    """Adds kind, subtype (the language of functions and procedures, else the kind), intent (what a deployment would do) and confidence.

    confidence: LOW where the extension of the file at `path` promises another type, HIGH where it promises this one or a
    language is named, else MEDIUM; permissions are never HIGH, and UNKNOWN statements have none.
    """
    masked = df.withColumn("__plain", mask_noise(F.col(text)))
    out = masked.withColumn("kind", classify(F.col("__plain"), kinds))
    named = [F.when((F.col("kind") == kind) & F.col("__plain").rlike("(?i)" + p), F.lit(sub)) for kind, subs in LANGUAGES.items() for sub, p in subs]
    out = out.withColumn("subtype", F.coalesce(*named, F.col("kind"))).drop("__plain")
    known = [F.when(F.col("kind").isin(*v), F.lit(k)) for k, v in INTENTS.items()]
    out = out.withColumn("intent", F.coalesce(*known, F.when(F.col(text).rlike(r"(?i)^\s*REPLACE\b"), "replace"), F.lit("create")))
    ending = F.lower(F.regexp_extract(F.coalesce(F.col(path), F.lit("")), r"\.([A-Za-z]+)$", 1)) if path else F.lit("")
    promised = F.coalesce(*[F.when(ending == e, F.array(*map(F.lit, k))) for e, k in EXTENSIONS.items()])
    fits = F.array_contains(promised, F.col("kind"))
    spoken = F.col("subtype").isin(*(subs[k][0] for subs in LANGUAGES.values() for k in range(len(subs) - 1)))
    defaulted = F.col("subtype").isin(*(subs[-1][0] for subs in LANGUAGES.values())) | F.col("kind").isin("GRANT", "REVOKE")
    sure = F.when(F.col("kind") == "UNKNOWN", None).when(~fits, "LOW").when(defaulted, "MEDIUM").when(spoken | fits, "HIGH").otherwise("MEDIUM")
    return out.withColumn("confidence", sure)


def of_kind(df: DataFrame, kind: str, text: str = "body", kinds=KINDS) -> DataFrame:
    """The statements of one kind. As the first match decides, the patterns after that kind's own are not tried."""
    last = max(k for k, (name, _) in enumerate(kinds) if name == kind)
    return df.where(classify(mask_noise(F.col(text)), kinds[: last + 1]) == kind)


_HEAD = rf"(?i)^\s*(?:CREATE|REPLACE)\s+(?:\w+\s+)*?(VIEW|TABLE|MACRO|PROCEDURE|FUNCTION|TRIGGER|INDEX)\s+{QUALIFIED}"


def extract_owner(df: DataFrame, text: str = "body", detail: bool = False) -> DataFrame:
    """Adds owner_db, owner_name of the CREATE or REPLACE head; null where there is none.

    detail: owner_kind, and specific_db, specific_name of a function's SPECIFIC clause as well.
    """
    part = lambda pattern, k: F.nullif(unquote(F.regexp_extract("__masked", pattern, k)), F.lit(""))
    masked = df.withColumn("__masked", mask_noise(F.col(text)))  # a column of its own, so that it is computed once
    made = [part(_HEAD, 2).alias("owner_db"), part(_HEAD, 3).alias("owner_name")]
    if detail:
        kind = F.when(F.upper(F.regexp_extract("__masked", _HEAD, 1)) == "INDEX", classify(F.col("__masked"))).otherwise(F.upper(part(_HEAD, 1)))
        named = rf"(?i)^\s*(?:CREATE|REPLACE)\s+FUNCTION\s(?s:.*?)\bSPECIFIC\s+{QUALIFIED}"
        made += [kind.alias("owner_kind"), part(named, 1).alias("specific_db"), part(named, 2).alias("specific_name")]
    return masked.select(*df.columns, *made)


#: Anchors that stand before a referenced name, with the privilege that they need (empty: none).
ANCHORS = (
    ("from", "SELECT"), ("comma", "SELECT"), ("join", "SELECT"), ("insert", "INSERT"), ("update", "UPDATE"), ("delete", "DELETE"), ("merge", "INSERT,UPDATE"), ("trigger_on", ""), ("foreign_key", "REFERENCES"), ("alter", ""),
    ("statistics", "STATISTICS"), ("call", "EXECUTE PROCEDURE"), ("exec", "EXECUTE"), ("locking", ""), ("index_on", ""), ("rename", ""), ("drop", ""), ("comment", ""), ("grant_on", ""),
)
_OBJECTS = frozenset("TABLE VIEW MACRO PROCEDURE FUNCTION TRIGGER INDEX JOIN HASH COLUMN SPECIFIC".split())
#: A word that starts to wait for a name: the anchor, and the words that may stand between.
_STARTS = {
    "FROM": ("from", frozenset()), "USING": ("from", frozenset()), "JOIN": ("join", frozenset()), "INSERT": ("insert", frozenset({"INTO"})), "UPDATE": ("update", frozenset()), "DELETE": ("delete", frozenset({"FROM"})),
    "MERGE": ("merge", frozenset({"INTO"})), "REFERENCES": ("foreign_key", frozenset({"WITH", "NO", "CHECK", "OPTION"})), "ALTER": ("alter", frozenset({"TABLE"})), "CALL": ("call", frozenset()), "EXEC": ("exec", frozenset()),
    "EXECUTE": ("exec", frozenset()), "LOCK": ("locking", frozenset({"ROW", "TABLE"})), "LOCKING": ("locking", frozenset({"ROW", "TABLE"})), "RENAME": ("rename", _OBJECTS), "DROP": ("drop", _OBJECTS), "COMMENT": ("comment", _OBJECTS | {"ON"}),
}
#: Words after which a comma at the same depth is no further source.
_ENDS = frozenset("WHERE GROUP ORDER HAVING QUALIFY SAMPLE UNION INTERSECT EXCEPT MINUS SET WHEN SELECT VALUES INSERT UPDATE DELETE MERGE".split())
_ON = {"GRANT": "grant_on", "INDEX": "index_on"}
_token = re.compile(rf"{QUALIFIED}|[A-Za-z_][A-Za-z0-9_$#]*|[(),;]")


def scan_refs(text: str | None) -> list[tuple[str, str, str, int, int]]:
    """(anchor, db, name, start, stop) of the qualified names that an anchor announces, in one pass over the text without its noise.

    A level is kept for each open parenthesis: whether a list of sources goes on there, so that a comma announces a further
    one, also behind a join's condition; and whether the parenthesis is that of EXTRACT or TRIM, whose FROM announces nothing.
    """
    out: list[tuple[str, str, str, int, int]] = []
    levels = [[False, False]]
    waits, between, on, last = "", frozenset(), "", ""
    for m in _token.finditer(blank_noise(text or "")):
        if m[2] is not None:
            if waits:
                out.append((waits, m[1].replace('"', ""), m[2].replace('"', ""), m.start(), m.end()))
            waits, last = "", ""
            continue
        word = m[0].upper()
        if word == "(":
            levels.append([False, last in ("EXTRACT", "TRIM")])
            waits = ""
        elif word == ")":
            if len(levels) > 1:
                levels.pop()
            waits = ""
        elif word == ";":
            levels, waits, on = [[False, False]], "", ""
        elif word == ",":
            waits, between = ("comma", frozenset()) if levels[-1][0] else ("", frozenset())
        elif word == "ON" and waits in ("insert", "update", "delete"):
            waits, between = "trigger_on", frozenset()
        elif waits and word in between:
            on = "index_on" if word == "INDEX" else on
        elif word == "ON" and on:
            waits, between, on = on, _OBJECTS, ""
        elif word in _STARTS and not (word == "FROM" and levels[-1][1]) and not (word in ("EXEC", "EXECUTE", "INSERT", "UPDATE", "DELETE") and on == "grant_on"):
            waits, between = _STARTS[word]
            if waits in ("from", "join"):
                levels[-1][0], on = True, "" if on == "index_on" else on
            elif word in _ENDS:
                levels[-1][0] = False
        elif word.startswith("STAT") and last in ("COLLECT", "UPDATE"):
            waits, on = "", "statistics"
        else:
            waits = ""
            if word in _ON:
                on = _ON[word]
            elif word in _ENDS:
                levels[-1][0], on = False, on if on in ("grant_on", "statistics") else ""
        last = word
    return out


def extract_refs(df: DataFrame, key: str, text: str = "body", anchors=ANCHORS, keep_owner: bool = False) -> DataFrame:
    """Distinct (key, anchor, ref_db, ref_name, privilege): qualified names after an anchor, but system databases and the owner.

    EXTRACT(.. FROM ..) and TRIM(.. FROM ..) are no anchors; a comma list is followed to its end, behind joins as well; only
    names with a qualifier count, so common-table and alias names cannot leak. keep_owner: owner_db and owner_name as well.
    """
    names = [a for a, _ in anchors]

    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"anchor": a, "db": d, "name": n} for a, d, n in dict.fromkeys(x[:3] for x in scan_refs(t))])

    owned = extract_owner(spread(df.select(key, text)), text)
    hits = F.pandas_udf(find, "array<struct<anchor:string,db:string,name:string>>")(F.col(text))
    found = owned.select(key, "owner_db", "owner_name", F.explode(hits).alias("h"))
    needs = F.coalesce(*[F.when(F.col("h.anchor") == a, F.lit(p)) for a, p in anchors])
    found = found.where(F.col("h.anchor").isin(*names)).select(key, "owner_db", "owner_name", "h.anchor", F.col("h.db").alias("ref_db"), F.col("h.name").alias("ref_name"), needs.alias("privilege"))
    own = (F.upper("ref_db") == F.upper("owner_db")) & (F.upper("ref_name") == F.upper("owner_name"))
    found = found.where(~F.upper("ref_db").isin(*SYSTEM) & ~F.coalesce(own, F.lit(False)))
    return (found if keep_owner else found.drop("owner_db", "owner_name")).distinct()


def extract_intents(df: DataFrame, key: str, text: str = "body") -> DataFrame:
    """Distinct (key, intent, ref_db, ref_name, privilege): reads, writes and calls, decided name by name."""
    refs = extract_refs(df, key, text).where("privilege != '' AND anchor != 'statistics' AND anchor != 'foreign_key'")
    intent = F.when(F.col("privilege") == "SELECT", "read").when(F.col("privilege").startswith("EXEC"), "call").otherwise("write")
    return refs.select(key, intent.alias("intent"), "ref_db", "ref_name", F.explode(F.split("privilege", ",")).alias("privilege")).distinct()


def extract_contract(df: DataFrame, text: str = "body") -> DataFrame:
    """(…, pos, name, direction, type) of tables, views with a column list, and procedures; names lower-cased."""
    head = re.compile(r"^\s*(?:CREATE|REPLACE)\s+(?:\w+\s+)*?(TABLE|VIEW|PROCEDURE)\s+[^\s(]+\s*\(", re.I)
    skip = re.compile(r"^(?:PRIMARY|UNIQUE|FOREIGN|CHECK|CONSTRAINT|INDEX|PERIOD)\b", re.I)
    noise = re.compile(NOISE)

    def columns(source: str | None) -> list[dict]:
        plain = noise.sub(lambda m: " " * len(m[0]), source or "")
        if not (m := head.match(plain)):
            return []
        depth, start, items = 1, m.end(), []
        for k in range(m.end(), len(plain)):
            depth += (plain[k] == "(") - (plain[k] == ")")
            if depth == 0 or (depth == 1 and plain[k] == ","):
                items.append(plain[start:k].split())
                start = k + 1
            if depth == 0:
                break
        out, kind = [], m[1].upper()
        for words in items:
            if not words or (kind == "TABLE" and skip.match(" ".join(words))):
                continue
            direction = None
            if kind == "PROCEDURE":
                direction = words.pop(0).upper() if words[0].upper() in ("IN", "OUT", "INOUT") else "IN"
            out.append({"name": words[0].strip('"').lower(), "direction": direction, "type": " ".join(words[1:2]).upper() if kind != "VIEW" else None})
        return out

    made = F.pandas_udf(lambda texts: texts.map(columns), "array<struct<name:string,direction:string,type:string>>")
    return df.select("*", F.posexplode(made(F.col(text))).alias("pos", "c")).select("*", "c.*").drop("c", text)


TOKEN = r"\{\{([A-Za-z0-9_-]+)\}\}"


def token_usage(df: DataFrame, key: str, text: str = "body") -> DataFrame:
    """Distinct (key, token) of {{NAME}} in the text."""
    return df.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1)))).alias("token"))


def malformed_tokens(df: DataFrame, key: str, text: str = "body") -> DataFrame:
    """(key, line_no, column_no, mark, line): braces left over when well-formed tokens are blanked to equal length."""
    token, left = re.compile(TOKEN), re.compile(r"\{\{|\}\}")

    def find(source: str | None) -> list[dict]:
        return [{"line_no": n, "column_no": m.start() + 1, "mark": m[0], "line": line} for n, line in enumerate((source or "").split("\n"), 1) for m in left.finditer(token.sub(lambda m: " " * len(m[0]), line))]

    made = F.pandas_udf(lambda texts: texts.map(find), "array<struct<line_no:int,column_no:int,mark:string,line:string>>")
    return df.where(F.col(text).rlike(r"\{\{|\}\}")).select(key, F.explode(made(F.col(text))).alias("m")).select(key, "m.*")


def replaced(value: str, pairs: str) -> str:
    """Every token of the value looked up once, so that what a value holds is not replaced in its turn; the map is made once a row."""
    token = r"'\\{\\{([A-Za-z0-9_-]+)\\}\\}'"
    pieces, names = f"split({value}, {token}, -1)", f"regexp_extract_all({value}, {token}, 1)"
    found = "coalesce(try_element_at(m, n), concat('{{', n, '}}'), '')"
    return f"transform(array(map_from_entries({pairs})), m -> array_join(zip_with({pieces}, {names}, (p, n) -> concat(p, {found})), ''))[0]"


def substitute_tokens(df: DataFrame, key: str, tokens: DataFrame, text: str = "body", env: str | None = None, strict: bool = False) -> DataFrame:
    """(key, text, n_substituted, undefined): every {{NAME}} replaced by its value in tokens(token, value[, env]).

    strict: a row with an undefined token fails the job.
    """
    on = ([env] if env else []) + ["token"]
    hits = df.select(key, *([env] if env else []), F.explode(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1))).alias("token")).groupBy(key, *on).agg(F.count("*").alias("n"))
    found = hits.join(tokens.select(*on, "value"), on, "left").groupBy(key).agg(
        F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("token", "value")))).alias("pairs"),
        F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("n_substituted"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("value").isNull(), F.col("token")))), ",").alias("undefined"))
    joined = df.select(key, text).join(found, key, "left")
    new = F.when(F.col("pairs").isNull(), F.col(text)).otherwise(F.expr(replaced(f"`{text}`", "pairs")))
    open_ = F.coalesce("undefined", F.lit(""))
    if strict:
        open_ = F.when(open_ == "", open_).otherwise(F.raise_error(F.concat(F.lit("undefined tokens: "), open_)).cast("string"))
    return joined.select(key, new.alias(text), F.coalesce("n_substituted", F.lit(0)).cast("long").alias("n_substituted"), open_.alias("undefined"))


def tokenise_prefixes(df: DataFrame, text: str, mapping: dict[str, str]) -> DataFrame:
    """Literals that lead an identifier (followed by _ and a character) become {{token}}, longest first; hits in n_prefixes.

    A literal that another mapped literal extends does not match where the longer one does, as that is replaced first.
    """
    done, hits = F.col(text), F.lit(0)
    for literal in sorted(mapping, key=lambda x: (-len(x), x)):
        pattern = rf"(^|[^A-Za-z0-9_{{])(?i:{re.escape(literal)})(_[A-Za-z0-9])"
        hits = hits + F.regexp_count(done, F.lit(pattern))
        done = F.regexp_replace(done, pattern, "$1" + re.sub(r"([$\\])", r"\\\1", "{{" + mapping[literal] + "}}") + "$2")
    return df.withColumn("n_prefixes", hits.cast("long")).withColumn(text, done)


def apply_rewrites(df: DataFrame, text: str, rules: list[tuple[str, str, str, bool]]) -> DataFrame:
    """Rules (name, pattern, replacement, first only) in order; adds hits_<name> for each, counted before its step."""
    done, out = F.col(text), df
    for name, pattern, new, first in rules:
        count = F.regexp_count(done, F.lit(pattern))
        out = out.withColumn(f"hits_{name}", (F.least(count, F.lit(1)) if first else count).cast("long"))
        whole = rf"^((?s:.*?)){pattern}" if first else pattern
        shifted = re.sub(r"\$(\d)", lambda m: f"${int(m[1]) + 1}", new)
        done = F.regexp_replace(done, whole, "$1" + shifted if first else new)
    return out.withColumn(text, done)


#: Typographic characters that have a documented plain form (a dash becomes spaced, since two open a comment).
PLAIN = {"—": " - ", "•": "-", "→": "->", "─": "-"}


def normalise_chars(text: Column) -> Column:
    """Documented characters replaced; U+FFFD and all others stay, to be reported by non_ascii."""
    for a, b in PLAIN.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def substitution_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(code_point as U+XXXX, n) of the characters that normalise_chars replaces."""
    found = df.select(F.explode(F.regexp_extract_all(text, F.lit("[" + "".join(PLAIN) + "]"), F.lit(0))).alias("character"))
    point = F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii("character")), 4, "0"))
    return found.select(point.alias("code_point")).groupBy("code_point").agg(F.count("*").alias("n"))


def non_ascii(df: DataFrame, text: str = "text") -> DataFrame:
    """(character, n): occurrences of each character beyond ASCII. Map-side sums, one row a character."""
    return df.select(F.explode(F.regexp_extract_all(text, F.lit(r"[^\x00-\x7F]"), F.lit(0))).alias("character")).groupBy("character").agg(F.count("*").alias("n"))


def strip_control_lines(text: Column) -> tuple[Column, Column]:
    """(text without lines that start with . and a letter, dropped lines); three or more newlines become two."""
    pattern = r"(?m)^[ \t]*\.[A-Za-z][^\n]*(?:\n|\z)"
    return F.regexp_replace(F.regexp_replace(text, pattern, ""), r"\n{3,}", "\n\n"), F.regexp_count(text, F.lit(pattern)).cast("long")


#: Categories of secrets and the lines that show them, in order; of a line the first counts.
SECRETS = (
    ("Inline PASSWORD assignment", r"""(?i)\bPASSWORD\s*=\s*['"][^'"]{4,}['"]"""),
    ("Inline PWD assignment", r"""(?i)\bPWD\s*=\s*['"][^'"]{4,}['"]"""),
    ("JDBC connection string", r"(?i)jdbc:[a-z]+://"),
    ("Teradata JDBC connection string", r"(?i)terajdbc:"),
    ("DSN connection string", r"""(?i)\bDSN\s*=\s*['"][^'"]+['"]"""),
    ("Private key header", r"-----BEGIN (?:RSA |EC |DSA )?PRIVATE KEY-----"),
    ("AWS Access Key ID pattern", r"(?i)AKIA[0-9A-Z]{16}"),
    ("AWS secret access key", r"(?i)aws_secret_access_key\s*=\s*[^\s]{20,}"),
)
#: References that a vault or the environment should have resolved.
UNRESOLVED = (("unresolved_ref", r"\$env:[A-Za-z_][A-Za-z0-9_]*|\bvault:\S+"),)
#: The leading folders whose files are scanned for secrets.
SECRET_FOLDERS = ("ddl", "viw", "dml", "dcl")


def in_folders(path: Column, folders: tuple[str, ...] = SECRET_FOLDERS) -> Column:
    """The path has more than one part and its first is one of the folders, in any case."""
    parts = F.split(path, r"[/\\]")
    return (F.size(parts) > 1) & F.lower(parts[0]).isin(*folders)


def scan_lines(df: DataFrame, key: str, text: str, patterns=SECRETS, path: str | None = None) -> DataFrame:
    """(key, line_no, category) of each line that matches a pattern, the first that does. The value itself is never returned.

    path: the column of file paths; only files of SECRET_FOLDERS count then.
    """
    files = df if path is None else df.where(in_folders(F.col(path)))
    lines = files.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("at", "line"))
    hit = F.coalesce(*[F.when(F.col("line").rlike(p), F.lit(c)) for c, p in patterns])
    return lines.select(key, (F.col("at") + 1).alias("line_no"), hit.alias("category")).where("category IS NOT NULL")


def dynamic_sql(df: DataFrame, key: str, text: str = "body") -> DataFrame:
    """(key, line_no, risk) of lines that run built statements: high when an identifier is joined in, else low."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line"))
    bare = F.regexp_replace("line", r"'(?:[^']|'')*'", "''")
    runs = bare.rlike(r"(?i)\bEXECUTE\s+IMMEDIATE\b|\bDBC\.SYSEXECSQL\b")
    joined = bare.rlike(r"\|\|\s*:?[A-Za-z_]|[A-Za-z_0-9]\s*\|\|")
    return lines.where(runs).select(key, (F.col("at") + 1).alias("line_no"), F.when(joined, "high").otherwise("low").alias("risk"))


#: Placeholder syntaxes of other tools.
FOREIGN = (("braced", r"\$\{(\w+)\}"), ("ampersand", r"&&(\w+)&&"), ("dollar", r"\$([A-Za-z_]\w*)"))


def foreign_placeholders(df: DataFrame, key: str, text: str = "body") -> DataFrame:
    """(key, syntax, variable, n) outside comments and literals; ${X} does not count as $X."""
    masked = mask_noise(F.col(text))
    hit = lambda syntax: lambda v: F.struct(F.lit(syntax).alias("syntax"), v.alias("variable"))
    found = [F.transform(F.regexp_extract_all(masked, F.lit(p), F.lit(1)), hit(s)) for s, p in FOREIGN]
    return df.select(key, F.explode(F.concat(*found)).alias("f")).groupBy(key, "f.syntax", "f.variable").agg(F.count("*").alias("n"))


def placeholder_positions(df: DataFrame, key: str, text: str = "body") -> DataFrame:
    """(key, syntax, variable, line_no, column_no) of each placeholder outside comments and literals; both count from 1."""
    patterns = [(syntax, re.compile(p)) for syntax, p in FOREIGN]

    def find(source: str | None) -> list[dict]:
        lines = blank_noise(source or "").split("\n")
        return [{"syntax": s, "variable": m[1], "line_no": n, "column_no": m.start() + 1} for n, line in enumerate(lines, 1) for s, p in patterns for m in p.finditer(line)]

    made = F.pandas_udf(lambda texts: texts.map(find), "array<struct<syntax:string,variable:string,line_no:int,column_no:int>>")
    return df.where(F.contains(F.col(text), F.lit("$")) | F.contains(F.col(text), F.lit("&&"))).select(key, F.explode(made(F.col(text))).alias("p")).select(key, "p.*")


def strip_affix(name: Column) -> Column:
    """A leading v_ and a trailing _v removed, in either case, but never to nothing."""
    bare = F.regexp_replace(F.regexp_replace(name, "^[vV]_", ""), "_[vV]$", "")
    return F.when(bare == "", name).otherwise(bare)


def strip_affixes(objects: DataFrame, refs: DataFrame) -> DataFrame:
    """refs(key, ref_db, ref_name) with new_name where it names a view of objects(db, name, kind) that loses its affix."""
    renamed = objects.where("kind = 'VIEW'").select(F.upper("db").alias("__db"), F.upper("name").alias("__name"), strip_affix(F.col("name")).alias("new_name")).where("upper(new_name) != __name").distinct()
    on = (F.upper("ref_db") == F.col("__db")) & (F.upper("ref_name") == F.col("__name"))
    return refs.join(renamed, on, "left").drop("__db", "__name").withColumn("new_name", F.coalesce("new_name", "ref_name"))


_name = re.compile(QUALIFIED)


def qualified_places(df: DataFrame, key: str, text: str = "body") -> DataFrame:
    """(key, db, name, start, dot, stop) of every qualified name outside literals and comments; offsets count code points from 0."""

    def find(source: str | None) -> list[dict]:
        return [{"db": m[1].replace('"', ""), "name": m[2].replace('"', ""), "start": m.start(), "dot": m.end(1), "stop": m.end()} for m in _name.finditer(blank_noise(source or ""))]

    made = F.pandas_udf(lambda texts: texts.map(find), "array<struct<db:string,name:string,start:int,dot:int,stop:int>>")
    return df.select(key, F.explode(made(F.col(text))).alias("p")).select(key, "p.*")


def spliced(df: DataFrame, key: str, edits: DataFrame, text: str = "body") -> DataFrame:
    """df with the text's parts edits(key, start, stop, new) replaced, from right to left, and n_edits added. key is unique in df."""
    each = edits.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", "stop", "new")), asc=False).alias("__edits"))

    def make(texts: pd.Series, all_edits: pd.Series) -> pd.Series:
        out = []
        for source, parts in zip(texts, all_edits):
            for e in parts if parts is not None and source is not None else ():
                source = source[: e["start"]] + e["new"] + source[e["stop"] :]
            out.append(source)
        return pd.Series(out, dtype=object)

    joined = df.join(each, key, "left")
    done = joined.withColumn(text, F.pandas_udf(make, "string")(F.col(text), F.col("__edits"))).withColumn("n_edits", F.coalesce(F.size("__edits"), F.lit(0)))
    return done.withColumn("n_edits", F.greatest("n_edits", F.lit(0)).cast("long")).select(*df.columns, "n_edits")


_star_token = re.compile(rf"({NAME})\.\*|{QUALIFIED}|[A-Za-z_][A-Za-z0-9_$#]*|\"[^\"]+\"|[(),;*]|\S")
_AFTER_SOURCE = frozenset("ON JOIN INNER LEFT RIGHT FULL CROSS OUTER NATURAL".split()) | _ENDS


def scan_stars(text: str | None) -> list[dict]:
    """Stars of select lists with the sources of their own SELECT: start, stop, qualifier (of alias.*), whole, sources (db, name, alias).

    whole is false where a source is a subquery or has no database. A star in count(*) or between two values is none.
    """
    out: list[dict] = []

    def fresh() -> dict:
        return {"list": False, "from": False, "source": False, "alias": False, "stars": [], "sources": [], "whole": True}

    def finish(scope: dict) -> None:
        for star in scope["stars"]:
            out.append(star | {"whole": scope["whole"] and bool(scope["sources"]), "sources": scope["sources"]})

    levels, last = [fresh()], ""
    for m in _star_token.finditer(blank_noise(text or "")):
        at, word = levels[-1], m[0].upper()
        if word == ";" or (word == ")" and len(levels) > 1):
            finish(levels.pop())
            levels = levels if word == ")" else [fresh()]
        elif word == "(":
            at["whole"] &= not at["source"]
            at["alias"], at["source"] = at["source"], False
            levels.append(fresh())
        elif word == "SELECT":
            finish(at)
            levels[-1] = fresh() | {"list": True}
        elif m[1] is not None or word == "*":
            if at["list"] and (m[1] is not None or last in ("SELECT", "DISTINCT", "ALL", ",")):
                at["stars"].append({"start": m.start(), "stop": m.end(), "qualifier": m[1] and m[1].replace('"', "")})
        elif word == "FROM" and at["list"]:
            at["list"], at["from"], at["source"] = False, True, True
        elif at["from"] and word in (",", "JOIN"):
            at["source"], at["alias"] = True, False
        elif at["from"] and word in _AFTER_SOURCE:
            at["alias"], at["source"], at["from"] = False, False, word not in _ENDS
        elif at["source"]:
            at["source"], at["alias"] = False, True
            if m[2] is not None:
                at["sources"].append({"db": m[2].replace('"', ""), "name": m[3].replace('"', ""), "alias": m[3].replace('"', "")})
            else:
                at["whole"] = False
        elif at["alias"] and word != "AS" and m[2] is None:
            at["alias"] = False
            if last != ")" and at["sources"]:
                at["sources"][-1]["alias"] = m[0].replace('"', "")
        last = word
    for scope in levels:
        finish(scope)
    return sorted(out, key=lambda x: x["start"])


def expand_stars(df: DataFrame, key: str, columns: DataFrame, text: str = "body") -> DataFrame:
    """df with * and alias.* of select lists as named columns, from columns(db, name, pos, column); adds n_edits and n_unresolved.

    Columns stand by source and place, qualified by the source's alias or name; one whose name an earlier source gave already
    gets qualifier_name. A star with a source that is a subquery, has no database or no known columns stays, and counts as
    unresolved, as does an alias that no source has.
    """
    made = F.pandas_udf(lambda texts: texts.map(scan_stars), "array<struct<start:int,stop:int,qualifier:string,whole:boolean,sources:array<struct<db:string,name:string,alias:string>>>>")
    scanned = cut(spread(df).withColumn("__stars", made(F.col(text))))  # each text is scanned once
    stars = scanned.select(key, F.explode("__stars").alias("s")).select(key, "s.*")
    each = stars.select(key, "start", "stop", "qualifier", "whole", F.posexplode_outer("sources").alias("nth", "o"))
    wanted = each.where("qualifier IS NULL OR upper(o.alias) = upper(qualifier)")
    known = columns.groupBy(F.upper("db").alias("__db"), F.upper("name").alias("__name")).agg(F.collect_set(F.struct("pos", "column")).alias("__columns"))
    met = wanted.join(known, (F.upper("o.db") == F.col("__db")) & (F.upper("o.name") == F.col("__name")), "left")
    # dealt by statement once, for the window, both groupings and the splice
    met = met.repartition(key).select("*", F.explode_outer("__columns").alias("__c")).select("*", "__c.pos", "__c.column")
    again = F.row_number().over(Window.partitionBy(key, "start", F.upper("column")).orderBy("nth", "pos")) > 1
    shown = F.concat("o.alias", F.lit("."), "column", F.when(again, F.concat(F.lit(" AS "), "o.alias", F.lit("_"), "column")).otherwise(""))
    listed = met.withColumn("shown", shown).groupBy(key, "start", "stop").agg(
        F.bool_and(F.col("whole") & F.col("column").isNotNull()).alias("good"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "pos", "shown"))), lambda x: x["shown"]), ", ").alias("new"))
    counted = scanned.withColumn("__n", F.size("__stars").cast("long")).drop("__stars")
    done = spliced(counted, key, listed.where("good").select(key, "start", "stop", "new"), text)
    return done.withColumn("n_unresolved", F.col("__n") - F.col("n_edits")).drop("__n")


def strip_affixes_in_text(df: DataFrame, key: str, objects: DataFrame, text: str = "body") -> DataFrame:
    """df with views of objects(db, name, kind) that lose their affix renamed wherever a qualified name means them; adds n_edits.

    Names are compared whole and without case; a new name stands in quotes if the old one did.
    """
    renamed = objects.where("kind = 'VIEW'").select(F.upper("db").alias("__db"), F.upper("name").alias("__name"), strip_affix(F.col("name")).alias("__new")).where("upper(__new) != __name")
    renamed = renamed.groupBy("__db", "__name").agg(F.min("__new").alias("__new"))
    places = qualified_places(df, key, text)
    met = places.join(renamed, (F.upper("db") == F.col("__db")) & (F.upper("name") == F.col("__name")))
    quoted = F.col("stop") - F.col("dot") - 1 > F.length("name")
    new = F.when(quoted, F.concat(F.lit('"'), "__new", F.lit('"'))).otherwise(F.col("__new"))
    return spliced(df, key, met.select(key, (F.col("dot") + 1).alias("start"), "stop", new.alias("new")), text)


def tokenise_text_by_kind(df: DataFrame, key: str, databases: DataFrame, kinds: DataFrame, text: str = "body", default: str = "T") -> DataFrame:
    """df with each database of databases(db) that qualifies a name turned into {{DB_suffix}}; adds n_edits.

    The suffix is that of the named object in kinds(db, name, suffix), else the default; tokens that stand there already stay.
    """
    known = databases.select(F.upper("db").alias("__known")).distinct()
    places = qualified_places(df, key, text).where("NOT startswith(db, '{{')").join(known, F.upper("db") == F.col("__known"))
    named = tokenise_by_kind(places.withColumnsRenamed({"db": "ref_db", "name": "ref_name"}), kinds, default)
    return spliced(df, key, named.select(key, "start", F.col("dot").alias("stop"), F.col("token").alias("new")), text)


def tokenise_by_kind(refs: DataFrame, kinds: DataFrame, default: str = "T") -> DataFrame:
    """refs(ref_db, ref_name) with token {{DB_kind}}: the suffix of the object's own kind in kinds(db, name, suffix)."""
    known = kinds.groupBy(F.lower("db").alias("__db"), F.lower("name").alias("__name")).agg(F.min("suffix").alias("__suffix"))
    on = (F.lower("ref_db") == F.col("__db")) & (F.lower("ref_name") == F.col("__name"))
    out = refs.join(known, on, "left")
    token = F.concat(F.lit("{{"), F.upper("ref_db"), F.lit("_"), F.coalesce("__suffix", F.lit(default)), F.lit("}}"))
    return out.withColumn("token", F.when(F.col("ref_db").startswith("{{"), F.col("ref_db")).otherwise(token)).drop("__db", "__name", "__suffix")
