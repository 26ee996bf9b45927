"""Text functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Format names with their aliases, and extensions.
FORMATS = {
    "commonmark": "commonmark", "gfm": "gfm", "markdown": "markdown", "md": "markdown", "html": "html", "html5": "html", "htm": "html", "xhtml": "html", "docx": "docx", "odt": "odt", "epub": "epub",
    "ipynb": "ipynb", "json": "json", "native": "json", "plain": "plain", "txt": "plain", "text": "plain", "latex": "latex", "tex": "latex", "rst": "rst", "asciidoc": "asciidoc", "adoc": "asciidoc",
}
ROMAN = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))
# Millimetres of a unit.
UNITS = {"mm": 1.0, "cm": 10.0, "in": 25.4, "pt": 25.4 / 72, "pc": 25.4 / 6, "px": 25.4 / 96}


def _replaced(c: Column, pairs) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def html_text(c: Column) -> Column:
    return _replaced(c, (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")))


def html_attribute(c: Column) -> Column:
    return _replaced(html_text(c), (('"', "&quot;"), ("'", "&#39;")))


def xml_text(c: Column) -> Column:
    """Escaped for XML; control characters but tab and line end are dropped."""
    return html_text(F.regexp_replace(c, r"[\x00-\x08\x0B-\x1F]", ""))


def latex_text(c: Column) -> Column:
    kept = F.translate(c, "\\~^", "\x01\x02\x03")
    named = F.regexp_replace(kept, r"([#$%&_{}])", r"\\$1")
    return _replaced(named, (("\x01", "\\textbackslash{}"), ("\x02", "\\textasciitilde{}"), ("\x03", "\\textasciicircum{}")))


def rst_text(c: Column) -> Column:
    return F.regexp_replace(c, r"([*`|\\])", r"\\$1")


def asciidoc_text(c: Column) -> Column:
    return F.regexp_replace(c, r"([*_#^~\\`])", r"\\$1")


# Noncharacters, which Unicode sets apart for use inside a program: 31 stand for control characters, one is a joint.
CONTROLS = "".join(map(chr, (*range(10), *range(11, 32))))
STAND_INS = "".join(chr(0xFDD0 + i) for i in range(31))
JOINT = "\ufdef"
_EDGE = r"[\s\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def carried(c: Column, runs: bool = False) -> Column:
    """Running text in which a reader of markdown or HTML finds each blank and line end by itself, and no block but one
    paragraph: a joint stands between neighbouring ones, at edges that would be lost, in empty text, and before what
    would start a block; control characters have stand-ins. With runs, blanks beside each other stay one gap."""
    plain = F.when(c.rlike(r"[\x00-\x09\x0b-\x1f]"), F.translate(c, CONTROLS, STAND_INS)).otherwise(c)
    start = rf"(?={_EDGE}|[-+>=~#]|\d{{1,9}}[.)])"
    joined = F.regexp_replace(plain, rf"\n{start}|\n(?=\n)| (?=\n)" if runs else rf"\n{start}|[ \n](?=[ \n])", f"$0{JOINT}")
    joined = F.when(joined.rlike("[^\\x00-\\x7f]\n"), F.regexp_replace(joined, rf"{_EDGE}(?=\n)", f"$0{JOINT}")).otherwise(joined)
    first = F.substring(plain, 1, 10).rlike(rf"\A(?:\z|{start})")
    return F.concat(F.when(first, JOINT).otherwise(""), joined, F.when(F.substring(plain, -1, 1).rlike(_EDGE), JOINT).otherwise(""))


def restored(c: Column) -> Column:
    """What came of carried() text without its joints and stand-ins."""
    text = F.replace(F.replace(c, F.lit(JOINT), F.lit("")), F.lit(STAND_INS[0]), F.lit("\0"))
    return F.when(c.rlike(r"[\ufdd0-\ufdef]"), F.translate(text, STAND_INS[1:], CONTROLS[1:])).otherwise(c)


def commonmark_text(c: Column, runs: bool = False) -> Column:
    """Running text as CommonMark: what is written is one paragraph of that text, whatever marks it holds."""
    return F.regexp_replace(carried(c, runs), r"[\\`*_\[\]<]|&(?=#?\w+;)", r"\\$0")


def lone_joints(c: Column) -> Column:
    """How many words of carried() text are joints alone."""
    return F.regexp_count(c, F.lit(rf"(?<![^ \n]){JOINT}+(?![^ \n])"))


def collapsed(c: Column) -> Column:
    return F.regexp_replace(c, r"[ \t\r\n]+", " ")


def tokens(c: Column) -> Column:
    """Words and runs of white space, in order."""
    return F.regexp_extract_all(c, F.lit(r"[ \t\r\n]+|[^ \t\r\n]+"), F.lit(0))


def gfm_slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"\s", "-"), r"[^\p{L}\p{N}_-]", "")


def auto_identifier(c: Column) -> Column:
    """Letters, digits, _ - . kept, lower case, words joined by -, up to the first letter dropped; else `section`."""
    kept = F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s_.-]", ""))
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(kept, r"\s+", "-"), r"^[^\p{L}]+", ""), F.lit("")), F.lit("section"))


def strip_ansi(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\x1b[^m]*m", ""), r"\x1b[\s\S]*$", "")


def format_of_name(c: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    return F.element_at(known, F.lower(c))


def format_of_path(c: Column) -> Column:
    return format_of_name(F.regexp_extract(c, r"\.([^./]+)$", 1))


def data_url_bytes(c: Column) -> Column:
    """Bytes of a data: URL, base64 or percent-encoded; null for anything else or what can't be decoded."""
    body = F.regexp_extract(c, r"(?s)^data:[^,]*,(.*)$", 1)
    packed = F.regexp_replace(body, r"\s", "")
    coded = F.when(packed.rlike(r"^[A-Za-z0-9+/]*={0,2}$"), F.try_to_binary(packed, F.lit("base64")))
    return F.when(c.rlike(r"^data:[^,]*;base64,"), coded).when(c.rlike("^data:[^,]*,"), F.try_url_decode(body).cast("binary"))


def roman(c: Column) -> Column:
    """Lower-case roman numeral of 1 to 3999, by folding over the table of values."""
    table = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(s).alias("s")) for v, s in ROMAN])
    start = F.struct(c.cast("int").alias("n"), F.lit("").alias("out"))
    step = lambda a, r: F.struct((a["n"] % r["v"]).cast("int").alias("n"), F.concat(a["out"], F.repeat(r["s"], F.floor(a["n"] / r["v"]).cast("int"))).alias("out"))
    return F.aggregate(table, start, step, lambda a: a["out"])


def alpha(c: Column) -> Column:
    """a, b, ..., z, aa, ab, ... of 1, 2, ...; up to seven letters."""
    start = F.struct(c.cast("long").alias("n"), F.lit("").alias("out"))
    letter = lambda n: F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), ((n - 1) % 26 + 1).cast("int"), F.lit(1))
    step = lambda a, _: F.when(a["n"] > 0, F.struct(F.floor((a["n"] - 1) / 26).cast("long").alias("n"), F.concat(letter(a["n"]), a["out"]).alias("out"))).otherwise(a)
    return F.aggregate(F.sequence(F.lit(1), F.lit(7)), start, step, lambda a: a["out"])


def length_mm(c: Column) -> Column:
    """Millimetres of a length with a unit; null without one."""
    unit = F.regexp_extract(c, r"([a-z]+)\s*$", 1)
    factor = F.element_at(F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair]), unit)
    return F.regexp_extract(c, r"^\s*(-?[0-9.]+)", 1).try_cast("double") * factor


def longest_run(c: Column, char: str) -> Column:
    """Length of the longest run of a character; a code fence or span around a text must be longer."""
    runs = F.regexp_extract_all(c, F.lit("[" + char + "]+"), F.lit(0))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def filled(c: Column, width: int) -> Column:
    """Words of a text in lines of at most width characters, longer words alone, as one greedy fold."""
    parts = F.filter(F.split(c, r"[ \t\r\n]+"), lambda w: w != "")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("used"))

    def step(a, w):
        fits = a["used"] + 1 + F.length(w) <= width
        return F.when(a["used"] == 0, F.struct(F.concat(a["out"], w).alias("out"), F.length(w).alias("used"))).when(
            fits, F.struct(F.concat(a["out"], F.lit(" "), w).alias("out"), (a["used"] + 1 + F.length(w)).alias("used"))
        ).otherwise(F.struct(F.concat(a["out"], F.lit("\n"), w).alias("out"), F.length(w).alias("used")))

    return F.aggregate(parts, start, step, lambda a: a["out"])
