"""Chat formatting with a grammar round trip, in built-in expressions only.

A turn is OPEN role MIDDLE text CLOSE. The text is everything between the first
MIDDLE and the CLOSE, so most texts need no escape. Every turn is first written
as it is and parsed again; where role or text do not come back, it is written
with ``\\``, ``<`` and ``[`` escaped and the escaped OPEN, after which no control
string can stand in it. A conversation is its turns, one after the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fluxweave.llm.tables import table

OPEN, OPEN_ESCAPED, MIDDLE, CLOSE = "[INST]", "[ESCI]", "[/INST]", "</s>"
ESCAPES = (("\\", "\\0"), ("<", "\\1"), ("[", "\\2"))  # the first is the escape itself
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def _written(role: Column, text: Column, open_: str) -> Column:
    return F.concat(F.lit(open_), role, F.lit(MIDDLE), text, F.lit(CLOSE))


def _read(piece: Column) -> Column:
    """Role and text of one turn without its CLOSE."""
    body = F.substring(piece, len(OPEN) + 1, 2**31 - 1)
    role = F.substring_index(body, MIDDLE, 1)
    text = F.substr(body, F.length(role) + 1 + len(MIDDLE))
    coded = F.startswith(piece, F.lit(OPEN_ESCAPED))
    return F.struct(
        F.when(coded, unescape(role)).otherwise(role).alias("role"), F.when(coded, unescape(text)).otherwise(text).alias("text")
    )


def parse(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation, as an array in order."""
    pieces = F.split(formatted, CLOSE, -1)
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), _read)


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss) for every conv_id of ``turns(conv_id, turn, role, text)``.

    ``loss`` holds the spans (start, chars; code points from 0) of the assistant
    texts in ``formatted``. Turns follow ``turn``, equal ones role and text; null
    role and text count as empty, a null turn comes first, and a null conv_id is
    a conversation of its own. Other columns are ignored. One conversation is
    one row, so it must fit into a row; its turns are not gathered before that.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    plain = _written(role, text, OPEN)
    back = parse(plain)
    same = (F.size(back) == 1) & (back[0]["role"] == role) & (back[0]["text"] == text)
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), same.alias("same"))
    rows = rows.select(
        "conv_id", "turn", "role", "text",
        F.when(F.col("same"), _written(F.col("role"), F.col("text"), OPEN)).otherwise(_written(escape(F.col("role")), escape(F.col("text")), OPEN_ESCAPED)).alias("piece"),
        F.when(F.col("same"), F.length("text")).otherwise(F.length(escape(F.col("text")))).alias("chars"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = F.sum(F.length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.select(
        "conv_id", "role", "piece", (upto - len(CLOSE) - F.col("chars")).alias("start"), F.col("chars").cast("long").alias("chars"), F.row_number().over(order).alias("no")
    )
    gathered = placed.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("no", "piece", "role", "start", "chars"))).alias("turns")
    )
    return gathered.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(
            F.filter("turns", lambda t: t["role"] == LOSS_ROLE), lambda t: F.struct(t["start"].alias("start"), t["chars"].alias("chars"))
        ).alias("loss"),
    )


def loss_texts(formatted: Column, loss: Column) -> Column:
    """Texts under the loss mask, unescaped, in order. A text is escaped if its own turn was opened so."""
    opened = len(OPEN) + len(LOSS_ROLE) + len(MIDDLE)  # the role that counts has no character to escape

    def read(span: Column) -> Column:
        text = F.substr(formatted, (span["start"] + 1).cast("int"), span["chars"].cast("int"))
        mark = F.substr(formatted, (span["start"] + 1 - opened).cast("int"), F.lit(len(OPEN)))
        return F.when(mark == OPEN_ESCAPED, unescape(text)).otherwise(text)

    return F.transform(loss, read)


def op5_chat_format(spark, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    clash = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(clash).alias("text")
    )
    out = format_turns(given.unionByName(more)).withColumn("turns", parse(F.col("formatted"))).withColumn(
        "under_loss", F.array_join(loss_texts(F.col("formatted"), F.col("loss")), "")
    )
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length("under_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("under_loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_CLASH = "</s>[INST] ok [/INST]"
_PLAIN_SQL = r"""replace(replace(replace({0}, '\', '\0'), '<', '\1'), '[', '\2')"""
OP5_SQL = rf"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_CLASH}' UNION ALL SELECT -7, 1, 'assistant', '{_CLASH}'
), sized AS (
  SELECT *, CASE WHEN contains(role || '{MIDDLE}' || text || '{CLOSE}', '{CLOSE}')
                  AND strpos(role || '{MIDDLE}' || text || '{CLOSE}', '{CLOSE}') = length(role || '{MIDDLE}' || text) + 1
                  AND strpos(role || '{MIDDLE}', '{MIDDLE}') = length(role) + 1
            THEN length(role) + length(text)
            ELSE length({_PLAIN_SQL.format("role")}) + length({_PLAIN_SQL.format("text")}) END AS chars
  FROM given
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = '{LOSS_ROLE}'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = '{LOSS_ROLE}'), '')) AS loss_sha256,
  CAST(sum(chars + {len(OPEN) + len(MIDDLE) + len(CLOSE)}) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
