"""Line-oriented sources: coverage profiles, manifests, requirement lists, criteria.

Each reads a table of texts (id, text) and works on its lines (id, n, line): what
a parser would keep as state is a running value over the lines of one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridelta.functions import text as tx

SATURATED = 1 << 30


def lines(texts: DataFrame) -> DataFrame:
    """id, n (from 0) and line; texts of a carriage return and a line feed lose the first."""
    return texts.select("id", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("line", F.regexp_replace("line", "\r$", ""))


def bare(c: Column | str) -> Column:
    """A text without white space at its ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _before(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)


def hunk_header(line: Column) -> Column:
    """Starts and counts of ``@@ -a,b +c,d @@``; a count that isn't given is 1; null if it is none."""
    p = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
    part = lambda i: F.when(F.regexp_extract(line, p, i) == "", F.lit(1)).otherwise(F.regexp_extract(line, p, i).try_cast("int"))
    return F.when(line.rlike(p), F.struct(part(1).alias("old_start"), part(2).alias("old_count"), part(3).alias("new_start"), part(4).alias("new_count")))


def name_status(texts: DataFrame) -> DataFrame:
    """status, path and old path of NUL-separated records: renames and copies have two paths, others one."""
    w = Window.partitionBy("id").orderBy("n")
    part = texts.select("id", F.posexplode(F.split("text", "\u0000")).alias("n", "v")).where("v <> ''")
    head = part.withColumn("_two", F.col("v").rlike("^[RC][0-9]+$")).withColumn("_one", F.col("v").rlike("^[AMDT]$"))
    out = head.withColumn("a", F.lead("v", 1).over(w)).withColumn("b", F.lead("v", 2).over(w)).withColumn("_after", F.lag(F.col("_two") | F.col("_one"), 1, False).over(w))
    return out.where(F.col("_two") | F.col("_one")).select("id", F.substring("v", 1, 1).alias("status"), F.when(F.col("_two"), F.col("b")).otherwise(F.col("a")).alias("path"), F.when(F.col("_two"), F.col("a")).otherwise("").alias("old_path"))


def coverage_format(texts: DataFrame) -> DataFrame:
    """block, lcov or unknown, by the first line that isn't blank."""
    first = lines(texts).where("trim(line) <> ''").groupBy("id").agg(F.min_by(bare("line"), "n").alias("f"))
    return first.select("id", F.when(F.col("f").startswith("mode:"), "block").when(F.col("f").rlike("^(TN|SF):"), "lcov").otherwise("unknown").alias("format"))


def block_profile(texts: DataFrame) -> DataFrame:
    """Blocks of ``file:line.col,line.col statements count``; counts of repeats add up; any other line but the first fails the read."""
    p = r"^(.+):(\d+)\.\d+,(\d+)\.\d+ (\d+) (\d+)$"
    rows = lines(texts).where((F.col("n") > 0) & (F.trim("line") != ""))
    g = lambda i: F.regexp_extract("line", p, i)
    ok = F.when(F.col("line").rlike(p), g(1)).otherwise(F.raise_error(F.concat(F.lit("not a coverage block: "), F.col("line"))))
    b = rows.select("id", ok.alias("file"), g(2).cast("int").alias("start_line"), g(3).cast("int").alias("end_line"), g(4).cast("int").alias("stmts"), g(5).cast("bigint").alias("count"))
    return b.groupBy("id", "file", "start_line", "end_line").agg(F.max("stmts").alias("stmts"), F.sum("count").alias("count"))


def lcov(texts: DataFrame) -> DataFrame:
    """file, line and count of DA records under the last SF; repeats add up, to at most 2**30."""
    w = _before(["id"])
    rows = lines(texts).withColumn("file", F.last(F.when(F.col("line").startswith("SF:"), F.substring("line", 4, 1 << 20)), ignorenulls=True).over(w))
    da = rows.where(F.col("line").rlike(r"^DA:\d+,\d+")).select("id", "file", F.regexp_extract("line", r"^DA:(\d+),", 1).cast("int").alias("line"), F.regexp_extract("line", r"^DA:\d+,(\d+)", 1).cast("bigint").alias("count"))
    return da.groupBy("id", "file", "line").agg(F.least(F.sum(F.least("count", F.lit(SATURATED))), F.lit(SATURATED)).alias("count"))


def framed(texts: DataFrame) -> DataFrame:
    """The payload of ``length:payload;``, whole to its last byte; anything else is null."""
    n = F.regexp_extract("text", r"^(\d{1,9}):", 1).try_cast("int")
    at = F.locate(":", F.col("text"))
    body = F.substring(F.col("text"), at + 1, F.length("text") - at - 1)
    return texts.select("id", F.when((F.octet_length(body) == n) & F.col("text").endswith(";"), body).alias("payload"))


def go_mod_requires(texts: DataFrame) -> DataFrame:
    """Modules of require lines and blocks."""
    w = _before(["id"])
    t = lines(texts).withColumn("line", bare(F.regexp_replace("line", "//.*$", "")))
    state = F.last(F.when(F.col("line").rlike(r"^require\s*\($"), 1).when(F.col("line") == ")", 0), ignorenulls=True).over(w)
    inside = t.withColumn("_in", F.coalesce(state, F.lit(0)))
    one, block = F.regexp_extract("line", r"^require\s+(\S+)\s+v", 1), F.regexp_extract("line", r"^(\S+)\s+v\S+", 1)
    return inside.select("id", F.when(one != "", one).when(F.col("_in") == 1, block).otherwise("").alias("name")).where("name <> ''").distinct()


def package_json_deps(texts: DataFrame) -> DataFrame:
    """Names of all kinds of dependencies, distinct."""
    m = "map<string,string>"
    j = F.from_json("text", f"dependencies {m}, devDependencies {m}, peerDependencies {m}, optionalDependencies {m}")
    keys = lambda k: F.coalesce(F.map_keys(j[k]), F.array().cast("array<string>"))
    return texts.select("id", F.explode(F.array_distinct(F.concat(*map(keys, ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies"))))).alias("name"))


def toml_keys(texts: DataFrame, sections: tuple[str, ...]) -> DataFrame:
    """Keys of the wanted sections and names of tables under them."""
    w = _before(["id"])
    t = lines(texts).withColumn("line", bare("line"))
    head = F.regexp_extract("line", r"^\[([^\[\]]+)\]", 1)
    s = t.withColumn("section", F.last(F.when(head != "", head), ignorenulls=True).over(w))
    keys = s.where(F.col("section").isin(*sections) & F.col("line").rlike(r"^[A-Za-z0-9_.\-\"]+\s*=")).select("id", F.regexp_replace(F.regexp_extract("line", r"^([A-Za-z0-9_.\-\"]+)\s*=", 1), '"', "").alias("name"))
    tables = s.where(head != "").select("id", F.explode(F.array(*(F.when(F.col("section").startswith(f"{x}."), F.substring("section", len(x) + 2, 1 << 10)) for x in sections))).alias("name")).where("name IS NOT NULL")
    return keys.union(tables).distinct()


def requirements(texts: DataFrame) -> DataFrame:
    """Names of requirement lines, in lower case; comments and options aren't any."""
    t = lines(texts).withColumn("line", bare(F.regexp_replace("line", "#.*$", ""))).where("line <> '' AND NOT startswith(line, '-')")
    return t.select("id", F.lower(F.regexp_extract("line", r"^([A-Za-z0-9._\-]+)", 1)).alias("name")).where("name <> ''").distinct()


def pyproject_deps(texts: DataFrame) -> DataFrame:
    """Names in dependency arrays and in the tables of Poetry, in lower case, without python itself."""
    arrays = texts.select("id", F.explode(F.regexp_extract_all("text", F.lit(r"(?s)dependencies\s*=\s*\[(.*?)\]"), F.lit(1))).alias("a"))
    names = arrays.select("id", F.explode(F.regexp_extract_all("a", F.lit(r"[\"']([A-Za-z0-9._\-]+)"), F.lit(1))).alias("name"))
    poetry = toml_keys(texts, ("tool.poetry.dependencies", "tool.poetry.dev-dependencies"))
    return names.union(poetry).select("id", F.lower("name").alias("name")).where("name <> 'python'").distinct()


IMPORTS = {"py": (r"^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))", r"^class\s+(\w+)"), "ts": (r"""(?:from|require\()\s*["']([^"']+)["']()""", r"^export\s+(?:class|interface|type)\s+(\w+)"), "rs": (r"^\s*use\s+([\w:]+)()", r"^pub\s+(?:struct|enum|trait)\s+(\w+)")}


def lexical_facts(texts: DataFrame, language: str) -> DataFrame:
    """Imports and types that lines of a language declare: id, fact, name, line."""
    imports, types = IMPORTS[language]
    t = lines(texts)
    name = F.concat(F.regexp_extract("line", imports, 1), F.regexp_extract("line", imports, 2))
    found = t.select("id", "n", F.explode(F.array(F.struct(F.lit("import").alias("fact"), name.alias("name")), F.struct(F.lit("type").alias("fact"), F.regexp_extract("line", types, 1).alias("name")))).alias("f"))
    return found.where("f.name <> ''").select("id", "f.fact", "f.name", (F.col("n") + 1).alias("line"))


def go_facts(texts: DataFrame) -> DataFrame:
    """Imports, of lines and blocks, and types that a Go text declares at its top level: id, fact, name, line. Strings elsewhere aren't imports."""
    w = _before(["id"])
    t = lines(texts).withColumn("bare", bare(F.regexp_replace("line", r"//.*$", "")))
    state = F.last(F.when(F.col("bare").rlike(r"^import\s*\($"), 1).when(F.col("bare") == ")", 0), ignorenulls=True).over(w)
    inside = F.coalesce(state, F.lit(0)) == 1
    one, block, kind = F.regexp_extract("bare", r'^import\s+(?:[\w.]+\s+)?"([^"]+)"$', 1), F.regexp_extract("bare", r'^(?:[\w.]+\s+)?"([^"]+)"$', 1), F.regexp_extract("line", r"^type\s+(\w+)\s", 1)
    name = F.when(one != "", one).when(F.col("_in") & (block != ""), block)
    found = t.withColumn("_in", inside).select("id", "n", F.explode(F.array(F.struct(F.lit("import").alias("fact"), name.alias("name")), F.struct(F.lit("type").alias("fact"), kind.alias("name")))).alias("f"))
    return found.where("f.name <> ''").select("id", "f.fact", "f.name", (F.col("n") + 1).alias("line"))


def knowledge_base(texts: DataFrame) -> DataFrame:
    """Entries under second-level headings: title, kind and paths from their fields, text from the rest."""
    w = _before(["id"])
    t = lines(texts).withColumn("entry", F.sum(F.when(F.col("line").startswith("## "), 1).otherwise(0)).over(w)).where("entry > 0")
    field = lambda k: F.max(F.when(F.col("line").rlike(f"^{k}: "), F.trim(F.regexp_replace("line", f"^{k}: ", ""))))
    rest = F.when(~F.col("line").rlike("^(## |kind: |paths: )") & (F.trim("line") != ""), F.struct("n", F.trim("line").alias("t")))
    g = t.groupBy("id", "entry").agg(F.max(F.when(F.col("line").startswith("## "), F.trim(F.substring("line", 4, 1 << 20)))).alias("title"), field("kind").alias("kind"), field("paths").alias("paths"), F.array_sort(F.collect_list(rest)).alias("r"))
    return g.select("id", "title", "kind", F.split("paths", r",\s*").alias("paths"), F.array_join(F.transform("r", lambda x: x["t"]), " ").alias("text"))


def criteria(texts: DataFrame, most: int = 50) -> DataFrame:
    """List items as numbered criteria; lines indented below one belong to it."""
    w = _before(["id"])
    item = F.col("line").rlike(r"^\s*([-*]|\d+\.)\s+\S")
    t = lines(texts).withColumn("item", F.sum(F.when(item, 1).otherwise(0)).over(w)).where("item > 0 AND trim(line) <> ''").where(item | F.col("line").rlike(r"^\s{2,}\S"))
    g = t.groupBy("id", "item").agg(F.array_sort(F.collect_list(F.struct("n", F.trim(F.regexp_replace("line", r"^\s*([-*]|\d+\.)\s+", "")).alias("t")))).alias("l"))
    return g.where(F.col("item") <= most).select("id", F.concat(F.lit("AC"), F.col("item").cast("string")).alias("criterion"), F.array_join(F.transform("l", lambda x: x["t"]), " ").alias("text"))


def shortstat(line: Column) -> Column:
    """Files, insertions and deletions of a summary line; 0 where one isn't named."""
    n = lambda p: F.coalesce(F.nullif(F.regexp_extract(line, p, 1), F.lit("")).try_cast("int"), F.lit(0))
    return F.struct(n(r"(\d+) files? changed").alias("files"), n(r"(\d+) insertions?\(").alias("insertions"), n(r"(\d+) deletions?\(").alias("deletions"))


def commit_history(texts: DataFrame, most: int = 300) -> DataFrame:
    """Commits of records ``sha<US>parents<US>subject`` on lines, in order, the first ``most``, and whether more were."""
    t = lines(texts).where("line <> ''").withColumn("p", F.split("line", "\u001f"))
    w = Window.partitionBy("id")
    return t.withColumn("place", F.row_number().over(w.orderBy("n"))).withColumn("limited", F.count(F.lit(1)).over(w) > most).where(F.col("place") <= most).select("id", "place", F.col("p")[0].alias("sha"), F.filter(F.split(F.col("p")[1], " "), lambda x: x != "").alias("parents"), F.col("p")[2].alias("subject"), "limited")


def commit_messages(texts: DataFrame, most: int = 200) -> DataFrame:
    """Messages that aren't blank, oldest first, the first ``most``."""
    t = texts.select("id", F.posexplode(F.reverse(F.split("text", "\u0000"))).alias("n", "message")).where("trim(message) <> ''")
    return t.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("n"))).where(F.col("place") <= most).select("id", "place", F.trim("message").alias("message"))


def report(texts: DataFrame, version: int = 1) -> DataFrame:
    """Versioned JSON reports with their signals; another version fails the read, unknown fields don't."""
    j = F.from_json("text", "schema_version int, exit_code int, signals array<struct<id string, kind string, path string, line int, severity string>>")
    ok = F.when(F.col("j.schema_version") == version, F.col("j")).otherwise(F.raise_error(F.lit("unknown report version")))
    return texts.select("id", j.alias("j")).select("id", ok.alias("j")).select("id", "j.exit_code", F.explode_outer("j.signals").alias("s")).select("id", "exit_code", "s.*")


def push_event(texts: DataFrame, forge: str = "github") -> DataFrame:
    """repository, branch, commit and whether the branch was deleted, of webhook bodies of either forge."""
    if forge == "github":
        j = F.from_json("text", "ref string, after string, deleted boolean, repository struct<id bigint, full_name string>")
        out = texts.select("id", j.alias("j")).select("id", F.col("j.repository.full_name").alias("repository"), F.col("j.ref").alias("ref"), F.col("j.after").alias("commit"), F.coalesce("j.deleted", F.lit(False)).alias("deleted"))
    else:
        j = F.from_json("text", "ref string, checkout_sha string, project struct<id bigint, path_with_namespace string>")
        out = texts.select("id", j.alias("j")).select("id", F.col("j.project.path_with_namespace").alias("repository"), F.col("j.ref").alias("ref"), F.col("j.checkout_sha").alias("commit"), F.col("j.checkout_sha").isNull().alias("deleted"))
    return out.where(F.col("ref").startswith("refs/heads/")).withColumn("branch", F.substring("ref", 12, 1 << 20)).drop("ref")


def jest_report(texts: DataFrame, message_bytes: int = 4096) -> DataFrame:
    """Assertions of a nested JSON report: file, name, status and messages, all with credentials masked; one without results or with a text that is no JSON fails the read.

    Each message is masked as a whole and then cut, between characters, to
    ``message_bytes``, since half a credential can't be told. Messages of an
    assertion are joined by line ends.
    """
    fields = "testResults array<struct<name string, assertionResults array<struct<fullName string, status string, failureMessages array<string>>>>>"
    valid = F.when(F.is_valid_utf8("text"), F.col("text")).otherwise(F.raise_error(F.lit("test results are no valid text")))
    j = F.from_json(valid, fields, {"mode": "FAILFAST"})
    ok = F.when(F.col("j.testResults").isNotNull(), F.col("j.testResults")).otherwise(F.raise_error(F.lit("no test results")))
    f = texts.select("id", j.alias("j")).select("id", F.explode(ok).alias("f"))
    a = f.select("id", F.col("f.name").alias("file"), F.explode("f.assertionResults").alias("a")).select("id", "file", "a.*")
    messages = F.transform("failureMessages", lambda m: tx.truncate_utf8(tx.redact(m), message_bytes))
    return a.select("id", tx.redact(F.col("file")).alias("file"), tx.redact(F.col("fullName")).alias("name"), tx.redact(F.col("status")).alias("status"), F.array_join(messages, "\n").alias("message"))


def junit_report(texts: DataFrame) -> DataFrame:
    """Cases of an XML report: class, name and outcome."""
    x = F.from_xml("text", "testcase array<struct<_classname string, _name string, failure string, error string, skipped string>>")
    c = texts.select("id", F.explode(x["testcase"]).alias("c"))
    outcome = F.when(F.col("c.failure").isNotNull(), "failed").when(F.col("c.error").isNotNull(), "error").when(F.col("c.skipped").isNotNull(), "skipped").otherwise("passed")
    return c.select("id", F.col("c._classname").alias("class"), F.col("c._name").alias("name"), outcome.alias("outcome"))


def observations(texts: DataFrame, prefix: str = "observe.") -> DataFrame:
    """(test, key, value) of attribute events whose key has a prefix; a line that can't be read fails its channel."""
    t = lines(texts).where("trim(line) <> ''").withColumn("j", F.from_json("line", "Action string, Test string, Key string, Value string"))
    bad = F.bool_or(F.col("line").contains('"attr"') & F.col("j.Action").isNull()).over(Window.partitionBy("id"))
    return t.withColumn("failed", bad).where((F.col("j.Action") == "attr") & F.col("j.Key").startswith(prefix)).select("id", F.col("j.Test").alias("test"), F.substring("j.Key", len(prefix) + 1, 1 << 20).alias("key"), F.col("j.Value").alias("value"), "failed")


def fuzz_stream(texts: DataFrame) -> DataFrame:
    """Records of JSON lines in order, and the state of each stream: complete, interrupted or invalid where indices don't follow one another."""
    t = lines(texts).where("trim(line) <> ''").withColumn("j", F.from_json("line", "i int, sha256 string, length int, state string"))
    w = Window.partitionBy("id").orderBy("n")
    rec = t.where("j.i IS NOT NULL").withColumn("_ok", F.col("j.i") == F.row_number().over(w) - 1)
    g = rec.groupBy("id").agg(F.count(F.lit(1)).alias("records"), F.bool_and("_ok").alias("_ok"))
    end = t.where("j.state IS NOT NULL").groupBy("id").agg(F.max("j.state").alias("_end"))
    state = F.when(~F.coalesce("_ok", F.lit(True)), "invalid").when(F.col("_end").isNotNull(), F.col("_end")).otherwise("interrupted")
    return texts.select("id").join(g, "id", "left").join(end, "id", "left").select("id", F.coalesce("records", F.lit(0)).alias("records"), state.alias("state"))


def jest_observations(texts: DataFrame) -> DataFrame:
    """(test, key, value) of JSON reports ``{"observed": {test: {key: value}}}``; values that aren't texts as their JSON. A text that is none gives no rows."""
    j = F.from_json("text", "observed map<string,map<string,string>>")
    t = texts.select("id", F.explode(j["observed"]).alias("test", "o"))
    return t.select("id", "test", F.explode("o").alias("key", "value"))


def junit_observations(texts: DataFrame, prefix: str = "observe.") -> DataFrame:
    """(test, key, value) of the properties of named cases whose name has a prefix; repeated keys stay."""
    x = F.from_xml("text", "testcase array<struct<_name string, properties struct<property array<struct<_name string, _value string>>>>>")
    c = texts.select("id", F.explode(x["testcase"]).alias("c")).select("id", F.col("c._name").alias("test"), F.explode("c.properties.property").alias("p"))
    return c.where(F.startswith("p._name", F.lit(prefix))).select("id", "test", F.substring("p._name", len(prefix) + 1, 1 << 20).alias("key"), F.col("p._value").alias("value"))


#: Fixed value: states that end a stream of results.
ENDS = ("complete", "interrupted", "timeout")


def fuzz_results(texts: DataFrame) -> DataFrame:
    """Records (id, i, call, sha256, length) of normalised result streams: a header line with the plan, a record a line, an end.

    A stream fails the read where its JSON can't be read, the header isn't the
    first line or doesn't count its calls, an index isn't the next one or is
    beyond the plan, a call isn't the planned one, a hash isn't 64 hexadecimal
    digits, a length is negative, or the end isn't the last line; a complete
    stream must hold all that was planned.
    """
    fields = "planned int, calls array<string>, i int, call string, sha256 string, length bigint, state string"
    t = lines(texts).where("trim(line) <> ''").withColumn("j", F.from_json("line", fields, {"mode": "FAILFAST"}))
    w = Window.partitionBy("id")
    o = w.orderBy("n")
    t = t.withColumn("place", F.row_number().over(o) - 1).withColumn("last", F.count(F.lit(1)).over(w) - 1).withColumn("h", F.first("j").over(o))
    head, end = F.col("j.planned").isNotNull(), F.col("j.state").isNotNull()
    i = F.col("j.i")
    reason = (
        F.when(head != (F.col("place") == 0), "header out of place").when(head & (F.col("j.planned") != F.size("j.calls")), "plan doesn't count its calls").when(head, F.lit(None))
        .when(end != (F.col("place") == F.col("last")), "end out of place").when(end & ~F.col("j.state").isin(*ENDS), "unknown end")
        .when(end & (F.col("j.state") == "complete") & (F.col("last") - 1 != F.col("h.planned")), "complete without all records").when(end, F.lit(None))
        .when(i.isNull() | (i != F.col("place") - 1), "index out of order").when(i >= F.col("h.planned"), "index beyond the plan")
        .when(~F.col("j.call").eqNullSafe(F.get("h.calls", i)), "call isn't the planned one").when(~F.coalesce(F.col("j.sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "no hash").when(~F.coalesce(F.col("j.length") >= 0, F.lit(False)), "no length")
    )
    checked = t.withColumn("j", F.when(reason.isNotNull(), F.raise_error(F.concat(F.col("id"), F.lit(": "), reason))).otherwise(F.col("j")))
    return checked.where("j.i IS NOT NULL OR j.state IS NOT NULL OR j.planned IS NOT NULL").where("j.i IS NOT NULL").select("id", "j.i", "j.call", "j.sha256", "j.length")


#: Where the title and the text stand in what each tracker returns.
TRACKERS = {
    "jira": ("key string, fields struct<summary string, description string>", "key", "fields.summary", "fields.description"),
    "linear": ("data struct<issue struct<identifier string, title string, description string>>", "data.issue.identifier", "data.issue.title", "data.issue.description"),
    "notion": ("id string, title string, markdown string", "id", "title", "markdown"),
    "docs": ("documentId string, title string, text string", "documentId", "title", "text"),
}


def issue_text(texts: DataFrame, tracker: str) -> DataFrame:
    """The intent that an issue or document states, as Markdown: its title as a heading, then its text; white space at its ends goes.

    Without a title the key is the heading; a body that can't be read gives null.
    """
    schema, key, title, text = TRACKERS[tracker]
    j = F.from_json("text", schema)
    t = texts.select("id", j.alias("j"))
    head = F.coalesce(F.nullif(bare(F.col(f"j.{title}")), F.lit("")), F.col(f"j.{key}"))
    body = bare(F.coalesce(f"j.{text}", F.lit("")))
    return t.select("id", F.concat(F.lit("# "), head, F.when(body != "", F.concat(F.lit("\n\n"), body)).otherwise("")).alias("intent"))
