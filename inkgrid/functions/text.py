"""Text of regions and of translator calls as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgrid.functions import patterns as P

# Forms of marks in vertical setting.
VERTICAL_FROM = "「」『』（）【】《》〔〕()[]~～〜―—-ーｰ|｜–…⋯‥⋮"
VERTICAL_TO = "﹁﹂﹃﹄︵︶︻︼︽︾︹︺︵︶︹︺︱︱︱︱︱︱︱︱︱︱︱︙︙︙︙"
#: White space as Python strips it: trim() leaves the wide blank.
_TRIM = r"^[\s\x{a0}\x{3000}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{85}\x{1c}-\x{1f}]+|[\s\x{a0}\x{3000}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{85}\x{1c}-\x{1f}]+$"
_LINES = r"\r\n|[\n\r\x{b}\x{c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _TRIM, "")


def lines(c: Column) -> Column:
    """Lines at every kind of line break."""
    return F.split(c, _LINES)


def tidy_reply(c: Column) -> Column:
    """A reply without leading dots, dashes and tildes; runs of them shortened; no blanks between adjacent ideographs or kana. A reply of nothing else stays as it is."""
    bare = strip(F.regexp_replace(c, P.HEAD, ""))
    x = bare
    for run, to in P.REPEATED:
        x = F.regexp_replace(x, run, to)
    x = F.regexp_replace(x, P.BETWEEN, "")
    return F.when(bare != "", x).otherwise(strip(c))


def strip_fence(c: Column) -> Column:
    """Content of a fenced block; text without a fence is only stripped."""
    t = strip(c)
    body = F.when(t.contains("\n"), F.regexp_replace(t, r"^[^\n]*\n", "")).otherwise(F.substring(t, 4, 1 << 30))
    closed = F.regexp_replace(body, r"```\z", "")
    return strip(F.when(t.startswith("```"), closed).otherwise(t))


def strip_index(c: Column) -> Column:
    """A line without its leading number."""
    return strip(F.regexp_replace(c, P.INDEX, ""))


def without_roles(arr: Column) -> Column:
    """Non-blank stripped lines that aren't role names."""
    return F.filter(F.transform(arr, strip), lambda x: (x != "") & ~F.lower(x).isin(*P.ROLES))


def let(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once: a lambda's argument is bound, a repeated expression is evaluated anew."""
    return F.element_at(F.transform(F.array(value), fn), 1)


_SEAM = "\x01"  # between the lines of one reply; no reply holds it


def indexed_output(content: Column, n: Column) -> Column:
    """Texts 1..n of a numbered reply as an array: continuation lines are joined by a blank, the last of a repeated number wins, numbers out of range and lines before the first number are dropped, missing ones are null.

    The lines are cut into pieces where a line begins with a number; each
    piece is matched once.
    """
    whole = F.array_join(without_roles(lines(F.replace(content, F.lit(_SEAM), F.lit("")))), _SEAM)
    pieces = F.split(whole, _SEAM + r"(?=\[?\d)")
    start = "(?s)" + P.NUMBERED.replace(r"\d+", r"\d{1,9}")
    numbered = F.transform(pieces, lambda x: F.struct(F.regexp_extract(x, start, 1).alias("i"), strip(F.replace(F.regexp_extract(x, start, 2), F.lit(_SEAM), F.lit(" "))).alias("text")))
    pick = lambda got, k: F.try_element_at(F.filter(got, lambda x: x["i"].cast("int") == k), F.lit(-1))["text"]
    found = let(F.filter(numbered, lambda x: x["i"] != ""), lambda got: F.transform(F.sequence(F.lit(1), n), lambda k: pick(got, k)))
    return F.when(n > 0, found).otherwise(F.array().cast("array<string>"))


def numbered_prompt(texts: Column) -> Column:
    """[1] …, [2] … lines of an array of texts; line breaks within a text become blanks."""
    return F.array_join(F.transform(texts, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), strip(F.regexp_replace(x, "\n", " ")))), "\n")


def user_message(text: Column, context: Column, source: str, target: str) -> Column:
    """Request with or without earlier translations."""
    ask = F.concat(F.lit(f"Translate from {source} to {target}:\n"), text)
    return F.when(F.coalesce(strip(context), F.lit("")) == "", ask).otherwise(F.concat(F.lit("Earlier lines:\n"), strip(context), F.lit("\n\n"), ask))


def joined_context(parts: Column) -> Column:
    """Non-blank earlier texts, one a line."""
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (strip(x) != "")), "\n")


def fill_template(template: str, source: Column, target: Column) -> Column:
    """Placeholders of a prompt template filled; the one for context is blanked."""
    x = F.replace(F.lit(template), F.lit("{{source_language}}"), source)
    x = F.replace(x, F.lit("{{target_language}}"), target)
    return strip(F.replace(x, F.lit("{{context}}"), F.lit("")))


def first_line(content: Column) -> Column:
    """First line that isn't blank or a role name, else the stripped content."""
    got = without_roles(lines(content))
    return F.coalesce(F.try_element_at(got, F.lit(1)), strip(content))


def message_content(json: Column) -> Column:
    return F.get_json_object(json, "$.message.content")


def max_tokens(n: Column) -> Column:
    return F.greatest(F.lit(256), 32 * n)


def vertical(c: Column) -> Column:
    """Text for vertical setting: tidied, runs of dots as one mark, marks in their vertical forms."""
    x = F.regexp_replace(tidy_reply(c), r"\.{2,}|．{2,}", "…")
    return F.translate(x, VERTICAL_FROM, VERTICAL_TO)


def short_title(c: Column) -> Column:
    """Blanks are dropped from titles of at most four characters that hold ideographs, kana or digits."""
    bare = F.regexp_replace(c, r"[\s\x{a0}\x{3000}]+", "")
    return F.when((F.length(bare) <= 4) & bare.rlike(r"[\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}0-9]"), bare).otherwise(c)


def text_width(c: Column, size: Column) -> Column:
    """Width without font metrics: 0.55 of the size for ASCII, the size for others."""
    ascii_n = F.length(F.regexp_replace(c, r"[^\x{1}-\x{7f}]", ""))
    return size * (F.lit(0.55) * ascii_n + (F.length(c) - ascii_n))


def text_height(c: Column, size: Column) -> Column:
    """Height in vertical setting: the size for each character."""
    return size * F.length(c)


def char_ids(c: Column, vocab: Column, unk: int = 3, bos: int = 1, eos: int = 2) -> Column:
    """Token ids of a character vocabulary (a map), framed; unknown characters get ``unk``."""
    chars = F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, ""))
    body = F.transform(chars, lambda x: F.coalesce(F.try_element_at(vocab, x), F.lit(unk)))
    return F.concat(F.array(F.lit(bos)), body, F.array(F.lit(eos)))


# Special tokens and their ids.
SPECIAL = ("<pad>", "<bos>", "<eos>", "<unk>")


def vocabulary(df: DataFrame, text: str) -> DataFrame:
    """(token, id): the special tokens and all characters of a column, numbered in code-point order from 4. Null and empty texts add none.

    Characters are made distinct before they are numbered, so the numbering
    sees no more rows than there are characters.
    """
    from inkgrid.sources.files import number_by_name

    chars = df.where(F.col(text) != "").select(F.explode(F.split(text, "")).alias("token")).where("token <> ''").distinct()
    numbered = number_by_name(chars.select("token", F.hex("token").alias("name"), F.lit(0).alias("seq")), "n").select("token", (F.col("n") + 3).cast("long").alias("id"))
    return df.sparkSession.createDataFrame(list(zip(SPECIAL, range(4), strict=True)), "token string, id long").unionByName(numbered)


def special_mask(ids: Column) -> Column:
    """1 where an id is one of the special tokens 0 to 3."""
    return F.transform(ids, lambda x: (x <= 3).cast("int"))


def chars_of(ids: Column, back: Column) -> Column:
    """Text of token ids; special tokens are dropped."""
    return F.array_join(F.transform(F.filter(ids, lambda x: x > 3), lambda x: F.coalesce(F.try_element_at(back, x), F.lit(""))), "")


def is_punctuation(c: Column) -> Column:
    return c.rlike(r"^[\p{P}~ー]$")


def is_content(c: Column) -> Column:
    """One letter or number that isn't a sound mark or tilde."""
    return c.rlike(r"^[\p{L}\p{N}]$") & ~c.isin("ー", "ｰ", "〜", "~")


def char_class(c: Column) -> Column:
    """'latin' (ASCII alphanumeric, ' - _), 'strong', 'clause', 'symbol' or 'other'."""
    # Marks that end a sentence and marks that end a clause.
    strong, clause = "。.．｡﹒！!﹗︕¡？?﹖︖¿؟…︙⋯‥⋮‼⁇⁈⁉‽۔︒", "，,、﹐﹑､；;︔؛：:︓؍"
    return (
        F.when(c.rlike(r"^[A-Za-z0-9'\-_]$"), "latin")
        .when(F.instr(F.lit(strong), c) > 0, "strong")
        .when(F.instr(F.lit(clause), c) > 0, "clause")
        .when(c.rlike(r"^[^\p{L}\p{N}\p{Z}\s]$"), "symbol")
        .otherwise("other")
    )
