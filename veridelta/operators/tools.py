"""A catalog of read-only questions about a change, and their dispatch by name."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veridelta.functions import text as tx

from . import dispatch, graph, store
from .core import alert_rank, top_with_total
from .security import java


@dataclass(frozen=True)
class Tool:
    """A named question: the tables it reads, its parameters and their kinds."""

    name: str
    about: str
    tables: tuple[str, ...]
    parameters: dict[str, str]
    run: Callable[..., DataFrame]

    def schema(self) -> dict:
        return {"type": "object", "properties": {k: {"type": v} for k, v in self.parameters.items()}, "required": sorted(self.parameters)}


def _from(signals: DataFrame, minimum: str) -> DataFrame:
    return signals.where(alert_rank("severity") >= alert_rank(F.lit(minimum)))


def _depth(depth) -> int:
    return min(max(int(depth), 1), 3)


def _own(runs: DataFrame, repo: str) -> DataFrame:
    return runs.where(F.col("repo_key") == repo)


def _bounded(limit, most: int = 200) -> int:
    return min(max(int(limit), 1), most)


def search_snapshot(docs: DataFrame, query: str, symbol: bool = False, most: int = 100, most_bytes: int = 65_536) -> DataFrame:
    """Lines (doc_id, line, text) of texts, credentials masked first, that hold a text, or have it between word boundaries.

    They come by document and line, up to the first that passes ``most`` lines or
    ``most_bytes``; a line is shown up to 1,000 bytes. A query has 1 to 256 bytes.
    """
    if not 1 <= len(query.encode()) <= 256:
        raise ValueError("a query has 1 to 256 bytes")
    holds = lambda c: F.contains(c, F.lit(query))
    # Masking adds nothing but its marker, so texts that don't hold the query are never masked or split.
    held = docs if query in tx.MARKER else docs.where(holds(F.col("text")))
    lines = held.select("doc_id", F.posexplode(F.split(tx.redact(F.col("text")), "\n")).alias("n", "text")).where(holds(F.col("text")))
    if symbol:
        lines = lines.where(F.col("text").rlike(java(r"\b" + re.escape(query) + r"\b")))
    first = lines.select("doc_id", (F.col("n") + 1).alias("line"), tx.truncate_utf8(F.col("text"), 1000).alias("text")).orderBy("doc_id", "line").limit(most)
    used = F.sum(F.octet_length("text")).over(Window.orderBy("doc_id", "line"))  # of at most ``most`` rows
    return first.withColumn("_used", used).where(F.col("_used") <= most_bytes).drop("_used")


CATALOG = {
    t.name: t
    for t in (
        Tool("search_graph", "nodes by name", ("nodes",), {"text": "string"}, lambda nodes, text: graph.search(nodes, text)),
        Tool("neighbors", "nodes near one", ("edges",), {"start": "string", "depth": "integer"}, lambda edges, start, depth: graph.neighbors(edges, start, depth=_depth(depth))),
        Tool("find_path", "a shortest chain", ("edges",), {"start": "string", "end": "string"}, lambda edges, start, end: graph.shortest_path(edges, start, end)),
        Tool("find_callers", "calls that lead to a function", ("calls", "nodes"), {"target": "string", "depth": "integer"}, lambda calls, nodes, target, depth: dispatch.callers(calls, nodes, target, _depth(depth))),
        Tool("find_references", "calls of a function", ("calls",), {"target": "string"}, lambda calls, target: calls.where(F.col("dst") == target)),
        Tool("inspect_symbol", "counts of a function", ("calls", "nodes"), {"target": "string"}, lambda calls, nodes, target: graph.inspect(calls, nodes).where(F.col("id") == target)),
        Tool("search_code", "lines that hold a text", ("docs",), {"query": "string"}, lambda docs, query: search_snapshot(docs, query)),
        Tool("get_diff", "changed lines of a file", ("diff_lines",), {"path": "string"}, lambda diff_lines, path: diff_lines.where(F.col("path") == path)),
        Tool("get_findings", "signals from a severity", ("signals",), {"minimum": "string"}, lambda signals, minimum: _from(signals, minimum)),
        Tool("list_repositories", "repositories by name", ("runs",), {"query": "string"}, lambda runs, query: store.named(runs, query)),
        Tool("get_repository", "the badge of a repository", ("runs",), {"repo": "string"}, lambda runs, repo: store.badge(_own(runs, repo))),
        Tool("list_analyses", "the newest runs of a repository", ("runs",), {"repo": "string", "limit": "integer"}, lambda runs, repo, limit: store.history(runs, repo, _bounded(limit))),
        Tool("list_active_analyses", "runs queued or running", ("runs",), {}, lambda runs: store.active(runs)),
        Tool("get_report", "the runs of a commit", ("runs",), {"repo": "string", "commit": "string"}, lambda runs, repo, commit: store.upsert(_own(runs, repo).where(F.col("commit") == commit), ["user_key", "repo_key", "commit", "variant"])),
        Tool("wait_for_analysis", "whether a run has left the queue", ("runs",), {"repo": "string", "commit": "string"}, lambda runs, repo, commit: settled(_own(runs, repo).where(F.col("commit") == commit))),
        Tool("list_feedback", "the newest comments", ("feedback",), {"limit": "integer"}, lambda feedback, limit: feedback.where("trim(comment) <> ''").orderBy(F.desc("seq")).limit(_bounded(limit))),
        Tool("get_learning", "votes by topic", ("feedback",), {}, lambda feedback: store.vote_counts(feedback)),
        Tool("get_usage", "tokens of a day by user", ("runs",), {"day": "string"}, lambda runs, day: store.usage_on(runs, day)),
    )
}


def catalog(spark: SparkSession) -> DataFrame:
    """name, about and JSON schema of each question."""
    return spark.createDataFrame([(t.name, t.about, json.dumps(t.schema(), sort_keys=True)) for t in CATALOG.values()], "name string, about string, schema string")


def settled(runs: DataFrame) -> DataFrame:
    """Of each repository and commit: the status last written and whether it has left the queue."""
    last = runs.groupBy("repo_key", "commit").agg(F.max_by("status", "seq").alias("status"))
    return last.withColumn("done", ~F.col("status").isin(*store.PENDING))


def call(name: str, tables: dict[str, DataFrame], **arguments) -> DataFrame:
    """Answer a question; one that isn't in the catalog, and missing or unknown arguments, are refused."""
    tool = CATALOG.get(name)
    if tool is None:
        raise KeyError(f"no tool {name!r}")
    if set(arguments) != set(tool.parameters):
        raise ValueError(f"{name} takes {sorted(tool.parameters)}")
    return tool.run(**{t: tables[t] for t in tool.tables}, **arguments)


def expand_command(command: list[str], unit: str) -> list[str]:
    """A policy's command with its unit in place of ``{package}``, argument by argument; nothing is run."""
    return [a.replace("{package}", unit) for a in command]


def expand_commands(units: DataFrame, command: list[str], unit: str = "unit") -> DataFrame:
    """``expand_command`` for a column of units: an array of arguments, however odd a unit is."""
    return units.withColumn("command", F.array(*(F.replace(F.lit(a), F.lit("{package}"), F.col(unit)) for a in command)))


def wait_for(query: StreamingQuery, seconds: float, poll: float = 0.2) -> bool:
    """Whether a stream ended within ``seconds``; one that failed raises its error."""
    end = time.monotonic() + seconds
    while time.monotonic() < end:
        if query.awaitTermination(int(max(1, poll))):
            return True
    return not query.isActive


#: Kinds of mutation, in rank order.
OPERATORS = ("drop_error", "negate_condition", "boundary", "negate_comparison", "swap_logical", "increment_constant", "flip_boolean", "swap_arithmetic")
#: What a token may be changed to, and the kind of mutation that is.
SWAPS = {
    "<": ("<=", "boundary"), "<=": ("<", "boundary"), ">": (">=", "boundary"), ">=": (">", "boundary"), "==": ("!=", "negate_comparison"), "!=": ("==", "negate_comparison"),
    "&&": ("||", "swap_logical"), "||": ("&&", "swap_logical"), "true": ("false", "flip_boolean"), "false": ("true", "flip_boolean"), "True": ("False", "flip_boolean"), "False": ("True", "flip_boolean"),
    "+": ("-", "swap_arithmetic"), "-": ("+", "swap_arithmetic"), "*": ("/", "swap_arithmetic"), "/": ("*", "swap_arithmetic"),
}
#: Tokens that tile a line: texts, comments, names, numbers, signs, anything else.
_TOKEN = r"""(?s)"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|`[^`]*`|(?://|#).*|[A-Za-z_]\w*|\d[\w.]*|&&|\|\||[=!<>]=|<<|>>|[-=]>|<-|:=|[-+*/%]=|\+\+|--|\s+|."""
_CONDITION = r"^(\s*(?:\}?\s*else\s+|el)?if\s+)(.*\S)\s*[{:]\s*$"
_ERROR = r"^(\s*return\s+(?:.*,\s*)?)((?:errors\.New|fmt\.Errorf)\(.*\)|err)\s*$"


def mutation_sites(lines: DataFrame, per_file: int = 2000) -> DataFrame:
    """Places on added lines that a mutant may change: path, line, at (from 1), operator, found, put, total; by line, rank of the operator and place, capped for each file.

    Every place counts, not the first of a line; texts and comments hold none. A
    sign is arithmetic between two operands of which neither is a text, a number
    is a constant after a comparison, ``if`` conditions are negated whole, and an
    error that a line returns last is dropped. Lines are taken one by one: what
    spans several has no site.
    """
    c = F.col("content")
    # Column by column, so that each is computed once a line.
    added = lines.where("kind = 'add'").select("path", "line", "content", F.regexp_extract_all(c, F.lit(_TOKEN), F.lit(0)).alias("tokens"))
    placed = F.transform("tokens", lambda t, i: F.struct((F.length(F.array_join(F.slice("tokens", 1, i), "")) + 1).alias("at"), t.alias("t")))
    added = added.withColumn("solid", F.filter(placed, lambda x: ~x["t"].rlike(r"^\s+$")))
    around = F.transform("solid", lambda x, i: F.struct(x["at"].alias("at"), x["t"].alias("t"), F.when(i > 0, F.get("solid", i - 1)["t"]).alias("before"), F.get("solid", i + 1)["t"].alias("after")))
    added = added.withColumn("around", around)
    pick = lambda t, k: F.element_at(F.create_map(*(F.lit(x) for a, b in SWAPS.items() for x in (a, b[k]))), t)
    operand = r"^[A-Za-z_0-9\)\]]"

    def site(x: Column) -> Column:
        number = x["t"].rlike(r"^\d+$") & x["before"].isin("<", "<=", ">", ">=", "==", "!=")
        arithmetic = F.coalesce(x["before"].rlike(operand) & x["after"].rlike(r"^[A-Za-z_0-9(]") & ~x["before"].isin("return", "case", "in", "if"), F.lit(False))
        sign = x["t"].isin("+", "-", "*", "/")
        return (
            F.when(number, F.struct(x["at"].alias("at"), F.lit("increment_constant").alias("operator"), x["t"].alias("found"), F.concat(F.lit("("), x["t"], F.lit("+1)")).alias("put")))
            .when(x["t"].isin(*SWAPS) & (~sign | arithmetic), F.struct(x["at"].alias("at"), pick(x["t"], 1).alias("operator"), x["t"].alias("found"), pick(x["t"], 0).alias("put")))
        )

    whole = lambda p, operator, put: F.when(
        c.rlike(p), F.struct((F.length(F.regexp_extract(c, p, 1)) + 1).alias("at"), F.lit(operator).alias("operator"), F.regexp_extract(c, p, 2).alias("found"), put.alias("put"))
    )
    wholes = F.array(whole(_ERROR, "drop_error", F.lit("nil")), whole(_CONDITION, "negate_condition", F.concat(F.lit("!("), F.regexp_extract(c, _CONDITION, 2), F.lit(")"))))
    found = F.filter(F.concat(wholes, F.transform("around", site)), lambda s: s.isNotNull())
    rows = added.select("path", "line", F.explode(found).alias("s")).select("path", "line", "s.*")
    rank = F.array_position(F.array(*map(F.lit, OPERATORS)), F.col("operator"))
    return top_with_total(rows, ["path"], [F.col("line"), rank, F.col("at")], per_file)


def bounded_neighbors(edges: DataFrame, start: str, budget: int, depth: int = 3) -> DataFrame:
    """Neighbours that a breadth-first search finds within a budget of edges looked at, and whether it ran out."""
    return graph.neighbors(edges, start, depth=depth, budget=budget)


def evict(entries: DataFrame, sample: int = 8) -> DataFrame:
    """The least active of ``sample`` keys of each group, the sample chosen by the SHA-256 of the key so that it can be repeated anywhere."""
    few = top_with_total(entries, ["store"], [F.sha2("key", 256)], sample)
    return few.groupBy("store").agg(F.min_by("key", F.struct("activity", "key")).alias("key"))
