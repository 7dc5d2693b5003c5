"""Named multi-step SQL jobs.

A procedure is a list of blocks in order.  A statement names its table and carries Spark SQL for
its query, condition or new values; ``#{name}`` binds a variable and ``${name}`` puts an identifier
or a literal into the text.  Every statement is one distributed query over the tables of a
``TableStore``.  A statement writes only what it adds: new rows, or bitmaps of deleted ones; all that a
block wrote becomes visible together when the block commits.

Cursor blocks do not walk rows: the declared action runs as one set operation over all cursor rows,
with a key and an order that say which row is the last one to touch a target row.  A value that every row
changes is computed by a parallel scan (``operators.running``).
"""

from __future__ import annotations

import itertools
import re
import threading
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from millrace.operators import merge
from millrace.operators.running import Body, Carried, Clamped, run_along
from millrace.plans.tables import AT, FILE, Affected, TableStore
from millrace.staging import Staging

# Outcome codes and their texts.
OK, FAILED, TIMED_OUT = 0, -1, -2
SUCCESS_INFO, FAIL_INFO, TIMEOUT_INFO = "success", "fail", "timeout"
MAX_CALL_DEPTH = 8

Value = int | str
Variables = dict[str, Value]

_BIND = re.compile(r"#(\{([^}]*)\})?")
_TEXT = re.compile(r"\$(\{([^}]*)\})?")
_PLACEHOLDER = re.compile(
    r"\?|'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.DOTALL)
_SAFE_TEXT = re.compile(r"[A-Za-z0-9_.]*")


class JobError(RuntimeError):
    """A job that cannot run, or did not finish."""


def _look_up(variables: Mapping[str, Value], name: str) -> Value:
    key = name.strip().lower()
    if key not in variables:
        raise JobError(f"variable {name} was not found")
    return variables[key]


def bind(sql: str, variables: Mapping[str, Value]) -> tuple[str, dict[str, Value]]:
    """Resolve ``${}`` to text and ``#{}`` to named markers; returns the text and its arguments."""

    def as_text(match: re.Match) -> str:
        if match.group(1) is None:
            raise JobError(f"position {match.start()}: '$' must open a variable")
        text = str(_look_up(variables, match.group(2)))
        if not _SAFE_TEXT.fullmatch(text):
            raise JobError(f"variable {match.group(2)} is not a plain name or number")
        return text

    arguments: dict[str, Value] = {}

    def as_marker(match: re.Match) -> str:
        if match.group(1) is None:
            raise JobError(f"position {match.start()}: '#' must open a variable")
        name = match.group(2).strip().lower()
        arguments[name] = _look_up(variables, name)
        return f" :{name} "

    return _BIND.sub(as_marker, _TEXT.sub(as_text, sql)), arguments


def checked_arguments(arguments: Mapping | Sequence) -> Mapping | Sequence:
    """Bind values Spark knows how to type; anything else is refused rather than turned to text."""
    import datetime
    import decimal

    known = (type(None), bool, int, float, str, bytes, decimal.Decimal, datetime.date, datetime.datetime)
    values = arguments.values() if isinstance(arguments, Mapping) else arguments
    for value in values:
        if not isinstance(value, known):
            raise JobError(f"cannot bind a value of type {type(value).__name__}")
    return arguments


def number_placeholders(sql: str) -> str:
    """Give each ``?`` outside of literals, quoted names and comments a name: ``:p1``, ``:p2``, …"""
    numbers = itertools.count(1)
    return _PLACEHOLDER.sub(lambda m: f":p{next(numbers)}" if m.group() == "?" else m.group(), sql)


def run_sql(spark: SparkSession, sql: str, arguments: Mapping | Sequence) -> DataFrame:
    """One statement with values bound by name (``:x``) or by position (``?``).

    Positions are turned into names, because Spark 4.1 mixes up the order of a list of five or
    more positional values.
    """
    arguments = checked_arguments(arguments)
    if not isinstance(arguments, Mapping):
        sql = number_placeholders(sql)
        arguments = {f"p{i}": value for i, value in enumerate(arguments, start=1)}
    return spark.sql(sql, args=arguments)


@dataclass(frozen=True)
class Param:
    name: str
    kind: str

    def __post_init__(self) -> None:
        if self.kind.lower() not in ("int", "string"):
            raise JobError(f"{self.name}: type {self.kind} is unsupported")
        object.__setattr__(self, "name", self.name.lower())

    def convert(self, value: object) -> Value:
        if value is None:
            raise JobError(f"{self.name} is NULL")
        if self.kind.lower() == "string":
            return str(value)
        whole = value if isinstance(value, int) and not isinstance(value, bool) else None
        if isinstance(value, str) and re.fullmatch(r"[+-]?[0-9]+", value):
            whole = int(value)
        elif isinstance(value, (float, Decimal)) and value == value and value % 1 == 0:
            whole = int(value)
        if whole is None or not -(1 << 63) <= whole < 1 << 63:
            raise JobError(f"{self.name}: converting {value!r} to int failed")
        return whole


@dataclass(frozen=True)
class Select:
    """SELECT INTO: the first row fills the variables."""

    order: int
    sql: str
    into: tuple[Param, ...]


@dataclass(frozen=True)
class Insert:
    order: int
    table: str
    query: str
    columns: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Update:
    order: int
    table: str
    assign: Mapping[str, str]
    where: str | None = None


@dataclass(frozen=True)
class Delete:
    order: int
    table: str
    where: str | None = None


Statement = Select | Insert | Update | Delete


def _in_order(items: Sequence, what: str) -> list:
    numbers = [item.order for item in items]
    twice = {n for n in numbers if numbers.count(n) > 1}
    if twice:
        raise JobError(f"{what} order {sorted(twice)} appears many times")
    return sorted(items, key=lambda item: item.order)


@dataclass(frozen=True)
class CommonBlock:
    """Statements in order, committed together."""

    order: int
    statements: tuple[Statement, ...]


@dataclass(frozen=True)
class LoopBlock:
    """Statements once per listed value; commits after every ``commit_every`` values."""

    order: int
    variable: Param
    values: tuple[Value, ...]
    statements: tuple[Statement, ...]
    commit_every: int = 1


@dataclass(frozen=True)
class Running:
    """A value that each cursor row changes: ``least(greatest(value + add, low), high)``, or, with ``carry``,
    the last value of that expression that was not NULL.

    The expressions are over the cursor columns.  The rows get it as ``name``, and as ``name_before``.
    """

    name: str
    add: str | None = None
    low: str | None = None
    high: str | None = None
    start: int = 0
    scale: int = 0
    carry: str | None = None

    def body(self, rows: DataFrame) -> Body:
        if self.carry is not None:
            return Carried(self.carry, rows.selectExpr(self.carry).schema[0].dataType.simpleString())
        return Clamped(self.add, self.low, self.high, self.start, self.scale)


@dataclass(frozen=True)
class CursorBlock:
    """One action over all rows of a query.

    ``delete`` removes target rows with a cursor key; ``insert`` appends all cursor rows;
    ``replace`` is delete and insert, last row per key; ``update`` sets columns from the last row.
    ``assign`` maps target columns to expressions over the cursor columns.

    A body that depends on the row before names the value it keeps (``running``), the order of the rows
    (``order_by``) and the columns it starts anew for (``within``).
    """

    order: int
    query: str
    table: str
    action: str
    key: tuple[str, ...] = ()
    order_by: tuple[str, ...] = ()
    assign: Mapping[str, str] | None = None
    running: Running | None = None
    within: tuple[str, ...] = ()


@dataclass(frozen=True)
class CallBlock:
    """Run another procedure with this block's variables as its parameters."""

    order: int
    procedure: str
    parameters: tuple[str, ...] = ()


Block = CommonBlock | LoopBlock | CursorBlock | CallBlock


@dataclass(frozen=True)
class Procedure:
    name: str
    blocks: tuple[Block, ...]
    in_params: tuple[Param, ...] = ()
    out_params: tuple[Param, ...] = ()

    def __post_init__(self) -> None:
        _in_order(self.blocks, "block")
        for block in self.blocks:
            if isinstance(block, (CommonBlock, LoopBlock)):
                _in_order(block.statements, "statement")


@dataclass(frozen=True)
class Job:
    procedure: str
    parameters: str = ""
    environment: str = ""
    timeout: float | None = None
    run_id: str = ""  # names attempts at the same run; a later one goes on where the last one failed


def parse_parameters(procedure: Procedure, text: str, separator: str = ",") -> Variables:
    """Typed variables from a comma list whose length must be exact."""
    values = text.split(separator) if text else []
    if len(values) != len(procedure.in_params):
        raise JobError(f"procedure {procedure.name} takes {len(procedure.in_params)} parameters, "
                       f"not {len(values)}")
    return {p.name: p.convert(v) for p, v in zip(procedure.in_params, values)}


def out_string(procedure: Procedure, variables: Mapping[str, Value]) -> tuple[str, list[str]]:
    """``k=v`` text of the out parameters, and the names that were never assigned."""
    assigned = [p.name for p in procedure.out_params if p.name in variables]
    missing = [p.name for p in procedure.out_params if p.name not in variables]
    return ",".join(f"{name}={variables[name]}" for name in assigned), missing


class _Work:
    """The uncommitted statements of a block.  Each is run, and what it adds is written, once."""

    def __init__(self, spark: SparkSession, store: TableStore, variables: Variables, affected: Affected):
        self.spark, self.store, self.variables, self.affected = spark, store, variables, affected
        self.change = store.begin()

    def query(self, sql: str) -> DataFrame:
        for name in self.store.names():
            self.change.read(name).createOrReplaceTempView(name)
        text, arguments = bind(sql, self.variables)
        return run_sql(self.spark, text, arguments)

    def matched(self, table: str, columns: str, where: str | None) -> DataFrame:
        """A query over the rows of a table that may also take their places."""
        self.change.placed(table).createOrReplaceTempView(f"__placed_{table}")
        hit = f"coalesce({where}, false)" if where else "true"
        return self.query(f"SELECT {columns} FROM __placed_{table} AS {table} WHERE {hit}")

    def run(self, statement: Statement) -> None:
        if isinstance(statement, Select):
            self._select(statement)
        elif isinstance(statement, Insert):
            schema = self.change.table(statement.table).schema
            self.change.insert(statement.table, merge.fitted_rows(schema, self.query(statement.query), statement.columns))
        elif isinstance(statement, Delete):
            if statement.where is None:
                self.change.clear(statement.table)
            else:
                self.change.delete(statement.table, self.matched(statement.table, f"{FILE}, {AT}", statement.where))
        elif isinstance(statement, Update):
            self._update(statement)
        else:
            raise JobError(f"unknown statement {type(statement).__name__}")

    def _select(self, statement: Select) -> None:
        if not statement.into:
            raise JobError("a select needs variables to fill")
        frame = self.query(statement.sql)
        if len(frame.columns) != len(statement.into):
            raise JobError(f"{len(frame.columns)} columns for {len(statement.into)} variables")
        row = frame.first()
        if row is None:
            raise JobError("the select returned no row")
        for param, value in zip(statement.into, row):
            self.variables[param.name] = param.convert(value)

    def _update(self, statement: Update) -> None:
        schema = self.change.table(statement.table).schema
        unknown = set(statement.assign) - set(schema.names)
        if unknown:
            raise JobError(f"unknown columns {sorted(unknown)} in {statement.table}")
        columns = [
            f"CAST({statement.assign[f.name]} AS {f.dataType.simpleString()}) AS `{f.name}`"
            if f.name in statement.assign else f"`{f.name}`" for f in schema.fields
        ]
        self.change.update(statement.table, self.matched(statement.table, ", ".join([*columns, FILE, AT]), statement.where))

    def cursor(self, block: CursorBlock, staging: Staging) -> None:
        rows = self.query(block.query)
        schema = self.change.table(block.table).schema
        if block.action in ("delete", "replace", "update") and not block.key:
            raise JobError(f"a cursor {block.action} needs a key")
        if block.action in ("replace", "update") and not block.order_by:
            raise JobError(f"a cursor {block.action} needs an order that decides the last row")
        if block.running is not None:
            if not block.order_by:
                raise JobError("a running value needs an order of the cursor rows")
            rows = run_along(rows, block.within, block.order_by, block.running.body(rows), block.running.name,
                             f"{block.running.name}_before", staging=staging)
        placed = self.change.placed(block.table)
        given = dict(block.assign or {})
        if block.action == "delete":
            self.change.delete(block.table, merge.matching(placed, rows, block.key, staging))
        elif block.action in ("insert", "replace"):
            if block.action == "replace":
                last = merge.last_per_key(rows, block.key, block.order_by, keep_loose=True)
                rows = staging.keep(last, "last")
                self.change.delete(block.table, merge.matching(placed, rows, block.key, staging))
            values = rows.selectExpr(*[f"{given.get(c, c)} AS `{c}`" for c in schema.names])
            self.change.insert(block.table, merge.fitted_rows(schema, values))
        elif block.action == "update":
            fresh = rows.selectExpr("*", *[f"{e} AS `__set_{c}`" for c, e in given.items()])
            self.change.update(block.table, merge.updated_rows(
                placed, fresh, block.key, block.order_by, {c: f"__set_{c}" for c in given}, staging))
        else:
            raise JobError(f"unknown cursor action {block.action!r}")

    def commit(self, token: str = "") -> None:
        self.affected.add(self.store.commit(self.change, token, self.variables if token else None))
        self.change = self.store.begin()


class _Journal:
    """The commits of a run that may be started again: each is noted in the log of the store itself."""

    def __init__(self, store: TableStore, path: str):
        self.store, self.path = store, path

    def token(self, step: object) -> str:
        return f"{self.path}/{step}" if self.path else ""

    def inner(self, step: object) -> _Journal:
        return _Journal(self.store, self.token(step))

    def done(self, step: object) -> Variables | None:
        """The variables at the end of a step that is committed."""
        return self.store.tokens.get(self.token(step)) if self.path else None


def execute(spark: SparkSession, store: TableStore, procedure: Procedure, variables: Variables,
            known: Mapping[str, Procedure] | None = None, depth: int = 0,
            affected: Affected | None = None, run_id: str = "") -> Variables:
    """Run a procedure; returns its variables.  What was committed before a failure stays.

    ``affected`` adds up the rows of the statements that were committed.  With a ``run_id`` every commit
    is noted in the log of the store, in the same step as its rows: the same call after a failure goes on
    behind the last commit, with the variables of that time, and no statement is applied twice.
    """
    affected = Affected() if affected is None else affected
    variables = {name.lower(): value for name, value in variables.items()}
    variables = _blocks(spark, store, procedure, variables, known or {}, depth, affected, _Journal(store, run_id))
    if run_id:
        store.finish(run_id)
    return variables


def _blocks(spark: SparkSession, store: TableStore, procedure: Procedure, variables: Variables,
            known: Mapping[str, Procedure], depth: int, affected: Affected, journal: _Journal) -> Variables:
    if depth > MAX_CALL_DEPTH:
        raise JobError(f"procedures call each other more than {MAX_CALL_DEPTH} deep")
    for block in _in_order(procedure.blocks, "block"):
        before = journal.done(block.order)
        if before is not None:
            variables = dict(before)
            continue
        work = _Work(spark, store, variables, affected)
        try:
            if isinstance(block, CommonBlock):
                for statement in _in_order(block.statements, "statement"):
                    work.run(statement)
                work.commit(journal.token(block.order))
            elif isinstance(block, LoopBlock):
                _loop(block, work, journal)
            elif isinstance(block, CursorBlock):
                with Staging(spark) as staging:
                    work.cursor(block, staging)
                    work.commit(journal.token(block.order))
            elif isinstance(block, CallBlock):
                if block.procedure not in known:
                    raise JobError(f"unknown procedure {block.procedure!r}")
                called = known[block.procedure]
                if len(block.parameters) != len(called.in_params):
                    raise JobError(f"procedure {called.name} takes {len(called.in_params)} parameters")
                inner = {p.name: p.convert(_look_up(variables, given))
                         for p, given in zip(called.in_params, block.parameters)}
                result = _blocks(spark, store, called, inner, known, depth + 1, affected, journal.inner(block.order))
                variables.update({p.name: result[p.name] for p in called.out_params if p.name in result})
            else:
                raise JobError(f"unknown block {type(block).__name__}")
        except BaseException:
            work.change.abandon()
            raise
    return variables


def _loop(block: LoopBlock, work: _Work, journal: _Journal) -> None:
    statements = _in_order(block.statements, "statement")
    inner = journal.inner(block.order)
    for number, value in enumerate(block.values, start=1):
        chunk = min(-(-number // block.commit_every) * block.commit_every, len(block.values))
        before = inner.done(chunk)
        if before is not None:
            work.variables.update(before)
            continue
        work.variables[block.variable.name] = block.variable.convert(value)
        for statement in statements:
            work.run(statement)
        if number == chunk:
            work.commit(inner.token(chunk))


class _Deadline:
    """Cancel the Spark jobs of this thread once the time is up, and again until the run has ended.

    Jobs are found by a tag, because a timer runs in a thread of its own.
    """

    def __init__(self, spark: SparkSession, seconds: float | None):
        self.context, self.seconds = spark.sparkContext, seconds
        self.tag = f"millrace-{uuid.uuid4().hex}"
        self.expired = False
        self._ended = threading.Event()

    def _watch(self) -> None:
        wait = self.seconds
        while not self._ended.wait(wait):
            self.expired, wait = True, 0.5
            self.context.cancelJobsWithTag(self.tag)

    def __enter__(self) -> _Deadline:
        if self.seconds is not None and self.seconds > 0:
            self.context.addJobTag(self.tag)
            self.context.setInterruptOnCancel(True)
            threading.Thread(target=self._watch, daemon=True).start()
        return self

    def __exit__(self, *_exc) -> None:
        self._ended.set()
        if self.seconds is not None and self.seconds > 0:
            self.context.removeJobTag(self.tag)
            self.context.setInterruptOnCancel(False)


RUN_LOG = (
    "environment string, procedure string, in_params string, out_params string, "
    "result_code int, result_info string, error string, rows_written map<string,bigint>, "
    "rows_deleted map<string,bigint>, seconds double"
)


def run_jobs(spark: SparkSession, store: TableStore, procedures: Sequence[Procedure],
             jobs: Sequence[Job], on_success: Callable | None = None,
             on_fail: Callable | None = None) -> DataFrame:
    """Run jobs one after the other; a failure is logged and does not stop the list.

    Returns the run log, one row per job.  The callbacks get that row as a dict.
    """
    known = {p.name: p for p in procedures}
    log = []
    for job in jobs:
        started = time.monotonic()
        row = {"environment": job.environment, "procedure": job.procedure, "in_params": job.parameters,
               "out_params": None, "result_code": OK, "result_info": SUCCESS_INFO, "error": None,
               "rows_written": {}, "rows_deleted": {}}
        affected = Affected(row["rows_written"], row["rows_deleted"])
        deadline = _Deadline(spark, job.timeout)
        try:
            if job.procedure not in known:
                raise JobError(f"unknown procedure {job.procedure!r}")
            procedure = known[job.procedure]
            variables = parse_parameters(procedure, job.parameters)
            with deadline:
                variables = execute(spark, store, procedure, variables, known, affected=affected, run_id=job.run_id)
            text, missing = out_string(procedure, variables)
            row["out_params"] = text
            if missing:
                row["error"] = "not assigned: " + ",".join(missing)
        except Exception as problem:  # any failure of a statement ends this job only
            code, info = (TIMED_OUT, TIMEOUT_INFO) if deadline.expired else (FAILED, FAIL_INFO)
            row |= {"result_code": code, "result_info": info, "error": str(problem).split("\n")[0]}
        row["seconds"] = time.monotonic() - started
        log.append(row)
        callback = on_success if row["result_code"] == OK else on_fail
        if callback:
            callback(row)
    return spark.createDataFrame([tuple(r.values()) for r in log], RUN_LOG)


def run_outcome(log: DataFrame) -> DataFrame:
    """Runs per procedure and result code."""
    return log.groupBy("procedure", "result_code", "result_info").count()
