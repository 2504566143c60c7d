"""Tool calls linked with their results, in topological order, validated and as canonical JSON.

Calls and results meet in a hash join by identifier. Where every call comes after the calls whose results it
uses, the places in the transcript are a topological order already, and no group of calls has to be sorted in
one task; in the other conversations levels are found by doubling along what each call waits for.

Defined cases: a call without a result is ``unanswered``, a result without a call ``orphan``; of calls (or
results) with one identifier in a conversation the first by place stands, and ``n_same`` counts them; calls
without an identifier are ``unidentified`` and not linked, results without one are left out; references to
unknown calls are counted and do not order; calls in or behind a cycle have no place; arguments that are no
JSON object are invalid; a call of an unknown tool is invalid; empty tables give no rows; further columns are
ignored; long arguments are read whole, in one row's expression. Canonical JSON has the keys of every object in
order and no blanks, and numbers by value, exact at any size: ``1``, ``1.0`` and ``1e0`` are one text, and an integer for
the schema's type. Digits are written out for powers of ten up to 40 either way, else as ``<digits>e<power>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm.common import Scratch

SALTS = 16
CALLS = "conv_id long, call_id string, turn long, idx long, name string, arguments string, after array<string>"
SCHEMAS = "name string, field string, type string, required boolean"
# JSON Schema's types by the names of variant types; numbers are strings behind a mark here
_TYPES = {"boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*", "null": "VOID"}
# Within marked JSON a number is a string that begins with \u0001n, and \u0001 itself is \u0001s. While a text is cut into
# tokens, an escaped backslash or quote is a control character, which JSON has not.
_NUMBER = r"-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+\-]?[0-9]++)?"
_TOKENS = rf'"[^"]*+"|{_NUMBER}|[^"0-9\-]++|[\-"0-9]'
_WRITTEN_OUT = 40


def _firsts(frame: DataFrame, order: tuple[str, ...], rest: tuple[str, ...]) -> DataFrame:
    """The first row of each identifier of a conversation, and how many there are."""
    item = F.struct(*order, *rest)
    return frame.groupBy("conv_id", "call_id").agg(F.min(item).alias("m"), F.count("*").alias("n_same")).select("conv_id", "call_id", *[F.col(f"m.{c}").alias(c) for c in (*order, *rest)], "n_same")


def _levels(calls: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, call_id, level (the most calls in a row that come before) of the calls of some conversations; those in or behind a circle are missing.

    An edge whose parent has one edge itself is drawn to that one's parent instead, and their lengths add up; an edge without a
    parent holds a level. So lengths double along calls with one parent each, and rounds grow with the logarithm of
    such a row. Edges never become more. A length beyond the number of calls goes in a circle.
    """
    total = calls.count()
    given = edges.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_k"), "parent")
    start = calls.select("conv_id", "call_id").join(given, (F.col("conv_id") == F.col("_c")) & (F.col("call_id") == F.col("_k")), "left").drop("_c", "_k")
    state = scratch.write(start.withColumns({"w": F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long"), "knot": F.lit(False), "moved": F.lit(True)}), "levels-0")
    turn = 0
    while True:
        lone = state.groupBy("conv_id", "call_id").agg(F.count("*").alias("_n"), F.max("parent").alias("_p"), F.max("w").alias("_w"), F.max("knot").alias("_knot")).filter("_n = 1")
        lone = lone.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_k"), "_p", "_w", "_knot")
        met = state.join(lone, (F.col("conv_id") == F.col("_c")) & (F.col("parent") == F.col("_k")), "left").withColumn("moved", F.col("_k").isNotNull())
        longer = F.col("w") + F.coalesce("_w", F.lit(0))
        drawn = met.select("conv_id", "call_id", F.when(longer <= total, F.when(F.col("moved"), F.col("_p")).otherwise(F.col("parent"))).alias("parent"), F.least(longer, F.lit(total)).alias("w"), (F.col("knot") | F.coalesce("_knot", F.lit(False)) | (longer > total)).alias("knot"), "moved")
        turn += 1
        state = scratch.write(drawn.groupBy("conv_id", "call_id", "parent").agg(F.max("w").alias("w"), F.max("knot").alias("knot"), F.max("moved").alias("moved")), f"levels-{turn}")
        scratch.drop(f"levels-{turn - 1}")
        open_, moved = state.agg(F.count("parent"), F.count_if("moved")).first()
        if not open_ or not moved:
            break
    known = state.groupBy("conv_id", "call_id").agg(F.count("*").alias("_n"), F.max("parent").alias("_p"), F.max("w").alias("level"), F.max("knot").alias("knot"))
    return known.filter("_n = 1 and _p is null and not knot").select("conv_id", "call_id", "level")


def _ordered(calls: DataFrame) -> DataFrame:
    """Adds order_major, order_minor, n_unknown: sorted by the first two, a conversation's calls follow what they use."""
    scratch = Scratch(calls.sparkSession)
    used = calls.select("conv_id", "call_id", "turn", "idx", F.explode(F.array_distinct("after")).alias("parent")).filter("parent is not null")
    parents = calls.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_p"), F.col("turn").alias("_t"), F.col("idx").alias("_i"))
    joined = used.join(parents, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("parent") == F.col("_p")), "left")
    backward = F.struct("_t", "_i") < F.struct("turn", "idx")
    edges = scratch.write(joined.select("conv_id", "call_id", "parent", F.col("_p").isNull().alias("unknown"), (F.col("_p").isNotNull() & ~F.coalesce(backward, F.lit(False))).alias("forward")), "edges")
    unknown = edges.filter("unknown").groupBy("conv_id", "call_id").agg(F.count("*").alias("n_unknown")).select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_p"), "n_unknown")
    out = calls.join(unknown, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("call_id") == F.col("_p")), "left").drop("_c", "_p").withColumn("n_unknown", F.coalesce("n_unknown", F.lit(0)).cast("long"))
    tangled = scratch.write(edges.filter("forward").select("conv_id").distinct(), "tangled")
    if tangled.isEmpty():
        return out.withColumn("order_major", F.col("turn")).withColumn("order_minor", F.col("idx"))
    inner = lambda frame: frame.join(tangled.withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c")), "left_semi")
    # within these conversations a null identifier of the conversation is a number of its own
    number = F.coalesce("conv_id", F.lit(-(1 << 63)))
    levels = _levels(inner(calls).withColumn("conv_id", number), inner(edges.filter("not unknown")).withColumn("conv_id", number).select("conv_id", "call_id", "parent"), scratch)
    marked = out.join(tangled.select(F.col("conv_id").alias("_t"), F.lit(True).alias("tangled")), F.col("conv_id").eqNullSafe(F.col("_t")), "left")
    levels = levels.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_p"), "level")
    placed = marked.join(levels, (number == F.col("_c")) & (F.col("call_id") == F.col("_p")), "left")
    known = F.col("level").isNotNull()
    return placed.withColumn("order_major", F.when(F.col("tangled").isNull(), F.col("turn")).otherwise(F.col("level"))).withColumn("order_minor", F.when(F.col("tangled").isNull(), F.col("idx")).when(known, F.col("turn"))).drop("_t", "tangled", "_c", "_p", "level")


def canonical_number(token: Column) -> Column:
    """A JSON number by its value; one whose power is no long stays as it is."""
    part = lambda i: F.regexp_extract(token, r"^-?([0-9]+)(?:\.([0-9]+))?(?:[eE]([+\-]?[0-9]+))?$", i)
    given = F.ltrim(F.concat(part(1), part(2)), F.lit("0"))
    digits = F.rtrim(given, F.lit("0"))
    power = F.when(part(3) == "", F.lit(0).cast("long")).otherwise(F.regexp_replace(part(3), r"^\+", "").try_cast("long")) - F.length(part(2)) + F.length(given) - F.length(digits)
    zeros = lambda n: F.repeat(F.lit("0"), n.cast("int"))
    whole = F.length(digits) + power
    out = F.when(power.between(0, _WRITTEN_OUT), F.concat(digits, zeros(power)))
    out = out.when(power.between(-_WRITTEN_OUT, -1) & (whole > 0), F.concat(F.substring(digits, F.lit(1), whole.cast("int")), F.lit("."), F.substring(digits, (whole + 1).cast("int"), F.length(digits))))
    out = out.when(power.between(-_WRITTEN_OUT, -1), F.concat(F.lit("0."), zeros(-whole), digits)).otherwise(F.concat(digits, F.lit("e"), power.cast("string")))
    return F.when(power.isNull(), token).when(digits == "", "0").otherwise(F.concat(F.when(token.startswith("-"), "-").otherwise(""), out))


def marked_json(text: Column) -> tuple[Column, Column]:
    """JSON with canonical numbers as marked strings, and with 0 for every number, which tells whether it was valid."""
    hidden = F.replace(F.replace(text, F.lit("\\\\"), F.lit("\x02")), F.lit('\\"'), F.lit("\x03"))
    tokens = F.when(~text.rlike("[\x02\x03]"), F.regexp_extract_all(hidden, F.lit(_TOKENS), F.lit(0)))
    number = lambda t: t.rlike(f"^{_NUMBER}$")
    shown = lambda made: F.replace(F.replace(F.array_join(F.transform(tokens, made), ""), F.lit("\x02"), F.lit("\\\\")), F.lit("\x03"), F.lit('\\"'))
    marked = lambda t: F.when(number(t), F.concat(F.lit('"\\u0001n'), canonical_number(t), F.lit('"'))).otherwise(F.replace(t, F.lit("\\u0001"), F.lit("\\u0001s")))
    return shown(marked), shown(lambda t: F.when(number(t), "0").otherwise(t))


def _unmarked(text: Column) -> Column:
    numbers = F.regexp_replace(text, r'"\\u0001n([^"]*)"', "$1")
    return F.regexp_replace(numbers, r"(?<!\\)((?:\\\\)*)\\u0001s", r"$1\\u0001")


def _sorted_map(arguments: Column) -> Column:
    return F.map_from_entries(F.transform(F.array_sort(F.map_keys(arguments)), lambda k: F.struct(k.alias("key"), F.element_at(arguments, k).alias("value"))))


def _validated(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """Adds arguments_json (canonical, null if no object) and errors (sorted)."""
    # a schema for every salt: all calls may be of one tool
    fields = schemas.groupBy(F.col("name").alias("_name")).agg(F.collect_set(F.struct("field", "type", "required")).alias("_fields"))
    salted = fields.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = calls.withColumn("_s", F.pmod(F.xxhash64("conv_id", "call_id"), F.lit(SALTS))).join(salted, (F.col("name") == F.col("_name")) & (F.col("_s") == F.col("_salt")), "left")
    marked, plain = marked_json(F.col("arguments"))
    joined = joined.withColumns({"_marked": marked, "_plain": plain})
    joined = joined.withColumn("_args", F.when(F.try_parse_json("_plain").isNotNull() & F.trim("arguments").startswith("{"), F.from_json("_marked", "map<string,variant>")))

    def problem(field: Column) -> Column:
        # a field that is not there has no entry
        value = F.try_element_at(F.col("_args"), field["field"])
        kind = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
        written = F.when(kind == "STRING", F.try_variant_get(value, "$", "string"))
        number = F.coalesce(written.startswith("\x01n"), F.lit(False))
        fits = ((field["type"] == "string") & (kind == "STRING") & ~number) | ((field["type"] == "number") & number) | ((field["type"] == "integer") & number & written.rlike("^.n-?[0-9]+(e[0-9]+)?$"))
        for name, pattern in _TYPES.items():
            fits = fits | ((field["type"] == name) & kind.rlike(f"^({pattern})$"))
        there = F.array_contains(F.map_keys("_args"), field["field"])
        return F.when(~there & field["required"], F.concat(F.lit("missing "), field["field"])).when(there & ~fits, F.concat(F.lit("wrong type of "), field["field"]))

    known = F.transform("_fields", lambda f: f["field"])
    surplus = F.transform(F.array_except(F.map_keys("_args"), known), lambda k: F.concat(F.lit("unknown "), k))
    errors = F.concat(F.filter(F.transform("_fields", problem), lambda x: x.isNotNull()), surplus)
    errors = F.when(F.col("_args").isNull(), F.array(F.lit("no object"))).when(F.col("_fields").isNull(), F.array(F.lit("unknown tool"))).otherwise(F.array_sort(errors))
    out = joined.withColumn("errors", errors).withColumn("arguments_json", F.when(F.col("_args").isNotNull(), _unmarked(F.to_json(_sorted_map(F.col("_args"))))))
    return out.drop("_s", "_salt", "_name", "_fields", "_args", "_marked", "_plain")


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row for each identifier of a conversation (see the module for the cases).

    calls: conv_id, call_id, turn, idx, name, arguments (JSON), after (identifiers of calls whose results it uses).
    results: conv_id, call_id, turn, content. schemas: name, field, type, required.
    """
    first_calls = _firsts(calls.filter("call_id is not null"), ("turn", "idx"), ("name", "arguments", "after"))
    nameless = calls.filter("call_id is null").select("conv_id", "call_id", "turn", "idx", "name", "arguments", "after", F.lit(1).cast("long").alias("n_same"))
    first_results = _firsts(results.filter("call_id is not null"), ("turn",), ("content",)).select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_r"), F.col("turn").alias("result_turn"), "content")
    placed = _ordered(first_calls).unionByName(nameless.withColumns({"n_unknown": F.lit(0).cast("long"), "order_major": F.lit(None).cast("long"), "order_minor": F.lit(None).cast("long")}))
    linked = _validated(placed, schemas).join(first_results, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("call_id") == F.col("_r")), "full")
    status = F.when(F.col("_r").isNull() & F.col("call_id").isNull(), "unidentified").when(F.col("_r").isNull(), "unanswered").when(F.col("call_id").isNull(), "orphan").otherwise("linked")
    # a JSON text within the canonical object is put in as it is
    quoted = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1), F.lit("null"))
    entry = lambda c: F.when(c.isNull(), F.lit("null")).otherwise(quoted(c))
    call_id = F.coalesce("call_id", "_r")
    canonical = F.concat(F.lit('{"arguments":'), F.coalesce("arguments_json", entry(F.col("arguments"))), F.lit(',"call_id":'), entry(call_id), F.lit(',"name":'), entry(F.col("name")), F.lit(',"result":'), entry(F.col("content")), F.lit("}"))
    return linked.select(
        F.coalesce("conv_id", "_c").alias("conv_id"), call_id.alias("call_id"), status.alias("status"), "name", "turn", "result_turn", "order_major", "order_minor",
        F.coalesce("n_unknown", F.lit(0).cast("long")).alias("n_unknown"), F.coalesce("n_same", F.lit(0).cast("long")).alias("n_same"),
        (F.col("errors").isNotNull() & (F.size("errors") == 0)).alias("valid"), F.array_join("errors", ", ").alias("errors"), canonical.alias("canonical"),
    )


def turns_as_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a table of turns (conv_id, turn, role, text) without recorded calls.

    A user's turn calls ``reply``, a system's turn ``instruct``; the assistant's turn is the result of the turn
    before it. A call uses the results of the turn two before it; in every sixth conversation that of the turn two
    behind it, and in every sixth both, which is a cycle. By the sum of conversation and turn, some calls lack
    their text, give the turn as a string or in another spelling, or have a field that no schema knows. Identifiers: conversation and turn.
    """
    name = lambda n: F.concat(F.col("conv_id").cast("string"), F.lit(":"), n.cast("string"))
    asked = turns.filter("role in ('user', 'system')")
    number, before, behind = F.col("conv_id") + F.col("turn"), name(F.col("turn") - 2), name(F.col("turn") + 2)
    fields = (F.when(number % 11 == 5, "x").alias("note"), F.when(number % 7 != 2, F.col("text")).alias("text"))
    # the same numbers in other spellings, large ones and objects in a surplus field
    respelt = lambda made: F.regexp_replace(F.regexp_replace(made, '"turn":([0-9]+)}$', F.when(number % 13 == 4, '"turn":$1.0}').when(number % 13 == 6, '"turn":$1e0}').otherwise('"turn":$1}')), '^[{]"note":"x"', F.when(number % 2 == 0, '{"note":12345678901234567890123').otherwise('{"note":{"b":1.50,"a":[-0.0,1E2]}'))
    calls = asked.select(
        "conv_id", name(F.col("turn")).alias("call_id"), "turn", F.lit(0).cast("long").alias("idx"),
        F.when(F.col("role") == "user", "reply").otherwise("instruct").alias("name"),
        respelt(F.when(number % 5 == 3, F.to_json(F.struct(*fields, F.col("turn").cast("string").alias("turn")))).otherwise(F.to_json(F.struct(*fields, "turn")))).alias("arguments"),
        F.when(F.col("conv_id") % 6 == 1, F.array(behind)).when(F.col("conv_id") % 6 == 2, F.array(before, behind)).when(F.col("turn") >= 2, F.array(before)).alias("after"),
    )
    results = turns.filter("role = 'assistant'").select("conv_id", name(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def turn_schemas(spark: SparkSession) -> DataFrame:
    rows = [(tool, field, kind, True) for tool in ("reply", "instruct") for field, kind in (("text", "string"), ("turn", "integer"))]
    return spark.createDataFrame(rows, SCHEMAS)


TURNS_SQL = """
WITH RECURSIVE calls AS (
  SELECT conv_id, conv_id || ':' || turn AS call_id, turn, CASE WHEN role = 'user' THEN 'reply' ELSE 'instruct' END AS name,
         CASE WHEN (conv_id + turn) % 7 <> 2 THEN text END AS text, (conv_id + turn) % 5 = 3 AS quoted, (conv_id + turn) % 11 = 5 AS noted, (conv_id + turn) % 2 = 0 AS even
  FROM conversations WHERE role IN ('user', 'system')),
uses AS (
  SELECT conv_id, call_id, turn, conv_id || ':' || (turn - 2) AS parent, false AS forward FROM calls WHERE conv_id % 6 = 2 OR (conv_id % 6 <> 1 AND turn >= 2)
  UNION ALL SELECT conv_id, call_id, turn, conv_id || ':' || (turn + 2), true FROM calls WHERE conv_id % 6 IN (1, 2)),
known AS (SELECT * FROM uses WHERE parent IN (SELECT call_id FROM calls)),
missing AS (SELECT call_id, count(*) AS n FROM uses WHERE parent NOT IN (SELECT call_id FROM calls) GROUP BY 1),
tangled AS (SELECT DISTINCT conv_id FROM known WHERE forward),
level(call_id, n) AS (
  SELECT call_id, 0::BIGINT FROM calls WHERE conv_id IN (SELECT conv_id FROM tangled) AND call_id NOT IN (SELECT call_id FROM known)
  UNION ALL SELECT known.call_id, level.n + 1 FROM level JOIN known ON known.parent = level.call_id),
place AS (SELECT call_id, max(n) AS n FROM level GROUP BY 1),
results AS (SELECT conv_id AS c, conv_id || ':' || (turn - 1) AS r, turn AS result_turn, text AS content FROM conversations WHERE role = 'assistant'),
linked AS (SELECT calls.*, results.*, missing.n AS n_missing, place.n AS at_level, calls.conv_id IN (SELECT conv_id FROM tangled) AS knotted
  FROM calls LEFT JOIN missing USING (call_id) LEFT JOIN place USING (call_id) FULL JOIN results ON call_id = r)
SELECT coalesce(conv_id, c) AS conv_id, coalesce(call_id, r) AS call_id,
       CASE WHEN r IS NULL THEN 'unanswered' WHEN call_id IS NULL THEN 'orphan' ELSE 'linked' END AS status,
       name, turn, result_turn, CASE WHEN knotted THEN at_level ELSE turn END AS order_major,
       CASE WHEN call_id IS NULL THEN NULL WHEN NOT knotted THEN 0::BIGINT WHEN at_level IS NOT NULL THEN turn END AS order_minor,
       coalesce(n_missing, 0)::BIGINT AS n_unknown, CASE WHEN call_id IS NULL THEN 0 ELSE 1 END::BIGINT AS n_same,
       call_id IS NOT NULL AND text IS NOT NULL AND NOT quoted AND NOT noted AS valid,
       CASE WHEN call_id IS NOT NULL THEN concat_ws(', ', CASE WHEN text IS NULL THEN 'missing text' END, CASE WHEN noted THEN 'unknown note' END, CASE WHEN quoted THEN 'wrong type of turn' END) END AS errors,
       '{"arguments":' || CASE WHEN call_id IS NULL THEN 'null' ELSE '{' || CASE WHEN noted AND even THEN '"note":12345678901234567890123,' WHEN noted THEN '"note":{"a":[0,100],"b":1.5},' ELSE '' END || coalesce('"text":' || to_json(text) || ',', '')
       || '"turn":' || CASE WHEN quoted THEN '"' || turn || '"' ELSE turn::VARCHAR END || '}' END || ',"call_id":' || to_json(coalesce(call_id, r))
       || ',"name":' || CASE WHEN name IS NULL THEN 'null' ELSE to_json(name) END || ',"result":' || CASE WHEN content IS NULL THEN 'null' ELSE to_json(content) END || '}' AS canonical
FROM linked"""
