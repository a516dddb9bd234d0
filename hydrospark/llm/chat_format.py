"""Operator 6, chat formatting: schema fingerprints select the mapping of each record to canonical turns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cols, let, q

TURNS = "array<struct<role:string,text:string>>"
HEAD, SEP, TAIL = "### ", ": ", "</turn>\n"
#: What may not stand inside roles and texts, and what stands for it; the escape itself first.
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))


@dataclass(frozen=True)
class Mapping:
    """One layout: an example with all its fields, from which its fingerprint is taken, and where turns are found in it.

    Either `turns` lists (role, field) for records with one field per turn, or `items` is the array of turns with `role` and
    `text` as field names and `names` as what its roles are called here.
    """

    name: str
    example: str
    turns: tuple[tuple[str, str], ...] = ()
    items: str = ""
    role: str = ""
    text: str = ""
    names: tuple[tuple[str, str], ...] = ()

    def canonical(self, record: Column) -> Column:
        if self.turns:
            got = F.from_json(record, ", ".join(f"`{f}` string" for _, f in self.turns))
            return let(got, lambda r: F.array(*(F.struct(F.lit(role).alias("role"), F.coalesce(r[f], F.lit("")).alias("text")) for role, f in self.turns)))
        got = F.from_json(record, f"`{self.items}` array<struct<`{self.role}`:string,`{self.text}`:string>>")[self.items]

        def turn(x: Column) -> Column:
            role = F.coalesce(x[self.role], F.lit(""))
            for theirs, ours in self.names:
                role = F.when(x[self.role] == theirs, ours).otherwise(role)
            return F.struct(role.alias("role"), F.coalesce(x[self.text], F.lit("")).alias("text"))

        return F.transform(got, turn)


MAPPINGS = (
    Mapping("messages", '{"messages":[{"role":"","content":""}]}', items="messages", role="role", text="content"),
    Mapping("from_value", '{"conversations":[{"from":"","value":""}]}', items="conversations", role="from", text="value", names=(("human", "user"), ("gpt", "assistant"))),
    Mapping("prompt_response", '{"prompt":"","response":""}', turns=(("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt_completion", '{"prompt":"","completion":""}', turns=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("instruction_input_output", '{"instruction":"","input":"","output":""}', turns=(("system", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("instruction_output", '{"instruction":"","output":""}', turns=(("user", "instruction"), ("assistant", "output"))),
)


def schema_fingerprint(record: Column) -> Column:
    """The hash of a JSON record's nested field paths: names in order of code point, arrays marked, value types left out."""
    paths = F.regexp_replace(F.schema_of_variant(F.try_parse_json(record)), r"(?<=[<:] ?)(?:STRING|VOID|BIGINT|BOOLEAN|DOUBLE|DECIMAL\(\d+,\d+\))(?=[,>]|$)", "*")
    return F.md5(paths)


def canonical_turns(records: DataFrame, record_col: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Adds fingerprint, layout and turns (role, text) to every JSON record.

    The fingerprint of a record is compared with those of the mappings, and the mapping that is found reads the turns. A
    record of no known layout, one that isn't JSON, an empty list of turns and null have layout and turns null and
    stay in the table, to be counted by fingerprint and mapped later. Null roles and texts are empty.
    """
    record, known = F.col(q(record_col)), F.col("fingerprint")
    out = records.withColumn("fingerprint", schema_fingerprint(record))
    layout = turns = None
    for m in mappings:
        here = known == schema_fingerprint(F.lit(m.example))
        layout = (F if layout is None else layout).when(here, F.lit(m.name))
        turns = (F if turns is None else turns).when(here, m.canonical(record).cast(TURNS))
    return out.withColumn("layout", layout).withColumn("turns", turns)


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def running(lengths: Column, block: int = 256) -> Column:
    """The sums of all lengths before each one. Blocks are summed first, so that what a fold copies at each step stays short and the whole is linear in the list but for a 65,536th of its square."""
    upto = lambda xs, first: F.aggregate(xs, F.array(first), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))

    def by_block(parts: Column) -> Column:
        sums = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x))
        return let(upto(sums, F.lit(0)), lambda firsts: F.flatten(F.transform(parts, lambda p, i: F.slice(upto(p, F.get(firsts, i)), F.lit(1), F.size(p)))))

    whole = lambda xs: F.transform(F.sequence(F.lit(0), F.size(xs), F.lit(block)), lambda at: F.slice(xs, at + 1, F.lit(block)))
    return let(lengths, lambda xs: let(whole(xs), by_block))


def format_chat(rows: DataFrame, turns_col: str = "turns", loss_role: str = "assistant") -> DataFrame:
    """Adds `formatted`, the text of all turns in the template, and `loss`, the spans (turn from 0, start, length; in code points) of `loss_role`'s texts.

    A turn is "### ", role, ": ", text, "</turn>" and a line feed. Inside roles and texts the backslash and the signs
    that markers are made of are escaped, so a text that looks like a marker can't end a turn and `read_chat` gives back
    what was put in. A null turn, role or text counts as empty. No turns: formatted and loss are null.
    """
    filled = lambda t: F.struct(*(escape(F.coalesce(t[k], F.lit(""))).alias(k) for k in ("role", "text")))
    written = lambda t: F.concat(F.lit(HEAD), t["role"], F.lit(SEP), t["text"], F.lit(TAIL))
    head = lambda t: F.char_length(t["role"]) + len(HEAD) + len(SEP)

    def spans(turns: Column) -> Column:
        begins = running(F.transform(turns, lambda t: head(t) + F.char_length(t["text"]) + len(TAIL)))
        each = lambda b: F.transform(turns, lambda t, i: F.struct(t["role"].alias("role"), i.alias("turn"), (F.get(b, i) + head(t)).alias("start"), F.char_length(t["text"]).alias("length")))
        mine = F.filter(let(begins, each), lambda s: s["role"] == escape(F.lit(loss_role)))
        return F.transform(mine, lambda s: F.struct(*(s[k].alias(k) for k in ("turn", "start", "length"))))

    turns = F.transform(q(turns_col), filled)
    return rows.withColumns({"formatted": F.array_join(F.transform(turns, written), ""), "loss": let(turns, spans)})


def read_chat(formatted: Column) -> Column:
    """The turns (role, text) of a formatted text."""

    def turn(x: Column) -> Column:
        at = F.instr(x, SEP)
        return F.struct(unescape(F.substring(x, F.lit(len(HEAD) + 1), at - len(HEAD) - 1)).alias("role"), unescape(F.substring(x, at + len(SEP), F.char_length(x))).alias("text"))

    return let(F.split(formatted, TAIL, -1), lambda p: F.transform(F.slice(p, F.lit(1), F.size(p) - 1), turn))


def loss_text(formatted: Column, loss: Column) -> Column:
    """The unescaped text under the loss mask. The text is cut at turn ends once, and each span is taken from the part of its turn."""

    def under(parts: Column) -> Column:
        begins = running(F.transform(parts, lambda x: F.char_length(x) + len(TAIL)))
        return let(begins, lambda b: F.array_join(F.transform(loss, lambda s: unescape(F.substring(F.get(parts, s["turn"]), s["start"] - F.get(b, s["turn"]) + 1, s["length"]))), ""))

    return let(F.split(formatted, TAIL, -1), under)


def pack_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One JSON record (conv_col, record) per conversation from a table of turns, in the plainest layout that holds it.

    Two turns of user and assistant become prompt and response, three with a system turn first instruction, input and output, other
    conversations of these roles from and value, all others messages. Turns are in order of `turn_col`, then role and text.
    """
    role, text = F.coalesce(F.col(q(role_col)), F.lit("")), F.coalesce(F.col(q(text_col)), F.lit(""))
    each = F.struct(F.col(q(turn_col)).alias("turn"), role.alias("role"), text.alias("text"))
    got = rows.groupBy(F.col(q(conv_col)).alias(conv_col)).agg(F.sort_array(F.collect_list(each)).alias("t"))
    roles, at = F.array_join("t.role", "\n"), lambda i: F.col("t")[i]["text"]
    plain = F.forall("t", lambda x: x["role"].isin("user", "assistant", "system"))
    theirs = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    record = (
        F.when(roles == "user\nassistant", F.to_json(F.struct(at(0).alias("prompt"), F.get("t", F.lit(1))["text"].alias("response"))))
        .when(roles == "system\nuser\nassistant", F.to_json(F.struct(at(0).alias("instruction"), F.get("t", F.lit(1))["text"].alias("input"), F.get("t", F.lit(2))["text"].alias("output"))))
        .when(plain, F.to_json(F.struct(F.transform("t", lambda x: F.struct(theirs(x["role"]).alias("from"), x["text"].alias("value"))).alias("conversations"))))
        .otherwise(F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"], x["text"].alias("content"))).alias("messages"))))
    )
    return got.select(conv_col, record.alias("record"))


def chat_digests(formatted: DataFrame) -> DataFrame:
    """Replaces turns, formatted and loss by counts and digests of what is read back from the formatted text."""
    out = formatted.withColumn("__turns", read_chat(F.col("formatted"))).withColumn("__loss", loss_text(F.col("formatted"), F.col("loss")))
    flat = F.array_join(F.transform("__turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        *cols(out, "turns", "formatted", "loss", "__turns", "__loss"), F.size("__turns").cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"),
        F.char_length("__loss").cast("long").alias("loss_chars"), F.sha2("__loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
