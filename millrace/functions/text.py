"""Text normal forms, word and sentence splits, and predicates on text fragments.

All are Catalyst expressions. Classes are spelled out (``\\p{L}`` and so on), as
Java's ``\\w`` and ``\\s`` cover ASCII only. Null texts give null unless said.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that draw table borders, and headings of report sections.
BORDERS = "|+-_=—–│┃┆┊┋┇┌┐└┘├┤┬┴┼"
SECTION_TERMS = (
    "business overview", "strategic report", "our strategy", "risk management", "corporate governance", "directors' report", "directors’ report",
    "financial statements", "financial review", "notes to the", "independent auditor", "sustainability", "shareholder information",
    "investor information", "operating review", "business performance", "chairman’s statement", "chairman's statement", "chief executive",
    "audit opinion", "accounting policies", "statement of financial position", "statement of cash flows",
)
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

#: White space; visible ASCII is told apart first, as the wide class costs ten times as much a character.
SPACE = r"(?:(?![!-~])[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}])"
_BORDER_CLASS = "[" + "".join("\\" + c if c in "|+-" else c for c in BORDERS) + "]"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


#: The characters of ``SPACE``; a table of characters costs a tenth of a regular expression.
_WIDE = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def collapse(c: Column) -> Column:
    """Every run of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.translate(c, _WIDE, " " * len(_WIDE)), " {2,}", " "))


def clean_text(c: Column) -> Column:
    """Layout clean-up that keeps lines: hyphenation at line ends joined, blanks collapsed, at most one empty line."""
    c = F.translate(c, " ­￾", " ")
    c = F.regexp_replace(c, r"(?<=[\p{L}\p{N}_])-\s*\n\s*(?=[\p{L}\p{N}_])", "")
    c = F.regexp_replace(c, "[ \t]+", " ")
    c = F.regexp_replace(c, " *\n *", "\n")
    return _trim(F.regexp_replace(c, "\n{3,}", "\n\n"))


#: First bytes of the wide white space in UTF-8, and of what ``flatten`` drops.
_LEADS = ("C2", "E19A80", "E280", "E2819F", "E38080", "EFBFBE")


def bound(c: Column, of) -> Column:
    """``of(c)`` with ``c`` known by name, so that it is worked out once however often ``of`` uses it."""
    return F.transform(F.array(c), of)[0]


def _flat(c: Column) -> Column:
    """Whether ``flatten`` changes nothing; looking for bytes costs a tenth of a table of characters."""
    wide = F.lit(False)
    for lead in _LEADS:
        wide = wide | F.contains(c.cast("binary"), F.unhex(F.lit(lead)))
    return ~(c.contains("  ") | c.rlike(r"[\x00-\x1f]") | c.startswith(" ") | c.endswith(" ") | ((F.octet_length(c) > F.length(c)) & wide))


def flatten(c: Column) -> Column:
    """Clean text on one line: of ``clean_text`` only the joined hyphens and dropped characters outlast it."""

    def changed(c: Column) -> Column:
        plain = F.translate(c, "\u00a0\u00ad\ufffe", " ")
        joined = F.regexp_replace(plain, r"(?<=[\p{L}\p{N}_])-\s*\n\s*(?=[\p{L}\p{N}_])", "")
        return collapse(F.when(plain.contains("\n"), joined).otherwise(plain))

    return F.when(_flat(c), c).otherwise(changed(c))


def clean_cell(c: Column) -> Column:
    """Flattened table cell; null gives the empty text."""
    return F.coalesce(flatten(c), F.lit(""))


def letters(c: Column) -> Column:
    """Number of letters."""
    return F.length(c) - F.length(F.regexp_replace(c, r"\p{L}", ""))


def border_ratio(c: Column) -> Column:
    """Share of border characters; 0 for the empty text."""
    n = F.length(c)
    drawn = F.contains(c.cast("binary"), F.unhex(F.lit("E2")))
    for x in BORDERS[:5]:
        drawn = drawn | c.contains(x)
    ratio = F.coalesce((n - F.length(F.translate(c, BORDERS, ""))) / F.nullif(n, F.lit(0)), F.lit(0.0))
    return F.when(drawn, ratio).otherwise(0.0)


def is_layout_line(c: Column) -> Column:
    """Whether a trimmed line only draws a border, or nearly."""
    # a third letter, which most lines have at once, settles it
    few = ~c.rlike(r"^(?:[^\p{L}]*\p{L}){3}")
    return (c == "") | (few & (c.rlike(f"^({SPACE}|{_BORDER_CLASS})+$") | (border_ratio(c) >= 0.40)))


def drop_layout_lines(c: Column) -> Column:
    """The text's trimmed lines without those that draw borders."""
    lines = F.transform(F.split(c, "\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085  ]", -1), _trim)
    return _trim(F.array_join(F.filter(lines, lambda x: ~is_layout_line(x)), "\n"))


def margin_form(c: Column, flat: Column | None = None) -> Column:
    """What a running header or footer has in common over pages: numbers masked, case and blanks folded; ``flat`` is ``flatten(c)`` where it is known."""

    def masked(line: Column) -> Column:
        return F.when(is_layout_line(line), "").otherwise(F.regexp_replace(F.lower(line), r"\p{Nd}+", "<number>"))

    def form(line: Column) -> Column:
        several = (line != c) & c.rlike("[\n\r\x0b\x0c\x1c-\x1e\u0085\u2028\u2029]")
        return F.when(several, collapse(F.regexp_replace(F.lower(drop_layout_lines(clean_text(c))), r"\p{Nd}+", "<number>"))).otherwise(masked(line))

    return bound(flatten(c), form) if flat is None else form(flat)


def dedup_form(c: Column) -> Column:
    """Lower case, blanks collapsed, then punctuation dropped (which can leave two blanks side by side)."""
    c = F.regexp_replace(F.lower(c), f"{SPACE}+", " ")
    return F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}_ ]+", ""))


def answer_form(c: Column) -> Column:
    """Lower case without ASCII punctuation, blanks collapsed."""
    return collapse(F.translate(F.lower(c), ASCII_PUNCTUATION, ""))


def section_form(c: Column) -> Column:
    """Lower-case ASCII letters and digits, all else one blank; null gives the empty text."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def question_form(c: Column) -> Column:
    return collapse(F.lower(c))


def safe_filename(c: Column, default: str = "report") -> Column:
    name = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(name, F.lit("")), F.lit(default))


def words(c: Column) -> Column:
    """Words between white space."""
    return F.array_remove(F.split(c, f"{SPACE}+", -1), "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def sentences(c: Column) -> Column:
    """Trimmed parts after each full stop, exclamation or question mark that white space follows."""
    return F.filter(F.transform(F.split(c, f"(?<=[.!?]){SPACE}+", -1), _trim), lambda s: s != "")


def word_slices(c: Column, size: int) -> Column:
    """Consecutive slices of ``size`` words, as texts."""
    # the array of one makes the words known by name, or they would be split again for each slice
    cut = F.transform(F.array(words(c)), lambda w: F.transform(
        F.when(F.size(w) > 0, F.sequence(F.lit(0), F.floor((F.size(w) - 1) / size).cast("int"))),
        lambda i: F.array_join(F.slice(w, i * size + 1, F.lit(size)), " "),
    ))
    return F.coalesce(cut[0], F.array().cast("array<string>"))


def pack_sentences(c: Column, most: int = 180) -> Column:
    """A paragraph of over ``most`` words as pieces: whole sentences while they fit, or slices of words where there are no sentences to tell."""

    def packed(parts: Column) -> Column:
        def add(s: Column, x: Column) -> Column:
            full = (s["n"] > 0) & (s["n"] + x["n"] > most)
            return F.when(full, F.struct(F.concat(s["done"], F.array(s["now"])).alias("done"), x["s"].alias("now"), x["n"].alias("n"))).otherwise(
                F.struct(s["done"].alias("done"), F.when(s["n"] > 0, F.concat(s["now"], F.lit(" "), x["s"])).otherwise(x["s"]).alias("now"), (s["n"] + x["n"]).alias("n"))
            )

        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("n"))
        return F.aggregate(F.transform(parts, lambda x: F.struct(x.alias("s"), word_count(x).alias("n"))), start, add, lambda s: F.concat(s["done"], F.array(s["now"])))

    # the array of one makes the sentences known by name
    by_sentence = F.transform(F.array(sentences(c)), lambda s: F.when(F.size(s) > 1, packed(s)))[0]
    return F.when(word_count(c) <= most, F.array(c)).otherwise(F.coalesce(by_sentence, word_slices(c, most)))


def starts_list_item(c: Column) -> Column:
    """Numbered, lettered or bulleted start."""
    return c.rlike(rf"^(?:\d+(?:\.\d+)*[.)]?|[A-Z][.)]|[-•▪‣]){SPACE}+")


def line_words(t: Column) -> Column:
    """Words of a flattened text, which has single blanks alone: no class of white space to look for."""
    return F.array_remove(F.split(t, " ", -1), "")


def _noise(t: Column) -> Column:
    """A quarter of border characters, or fewer than five letters: which texts that are empty, or borders, marks and numbers alone, have as well."""
    return (border_ratio(t) >= 0.25) | ~t.rlike(r"^(?:[^\p{L}]*\p{L}){5}")


def is_noise(c: Column) -> Column:
    """Whether a fragment says too little: empty, borders, numbers, hardly a letter. Null counts as empty."""
    return _noise(_trim(F.coalesce(c, F.lit(""))))


def noise_line(t: Column) -> Column:
    """``is_noise`` of a flattened text."""
    return _noise(t)


def decorative_line(t: Column, min_words: int = 2) -> Column:
    """``is_decorative`` of a flattened text."""
    few = ~t.contains(" ") if min_words == 2 else F.size(line_words(t)) < min_words
    return _noise(t) | (few & (t.rlike(rf"^([\d.,%₦N$€£+|/–—-]|{SPACE})+$") | (F.length(t) <= 2)))


def is_decorative(c: Column, min_words: int = 2) -> Column:
    """Noise, or a single word that is a number, an amount or at most two characters."""
    return decorative_line(flatten(F.coalesce(c, F.lit(""))), min_words)


def heading_line(t: Column, bold: Column, font: Column, body_font: Column) -> Column:
    """``is_heading`` of a flattened text."""
    known = F.lit(False)
    for term in SECTION_TERMS:
        known = known | F.lower(t).contains(term)
    large = bold & (body_font > 0) & (font >= 1.25 * body_font)
    # the cheap tests come first, as most blocks fail them
    shape = (F.length(t) <= 160) & ~t.rlike("[.,;]$") & F.size(line_words(t)).between(1, 16) & ~t.rlike(rf"^([\d./%₦N$€£|–—-]|{SPACE})+$")
    return shape & (F.coalesce(large, F.lit(False)) | known)


def is_heading(c: Column, bold: Column, font: Column, body_font: Column) -> Column:
    """Likely section heading: 1 to 16 words, and a known term or bold and large type.

    The number of words is bounded as evidently meant; the published form
    compares a list with a number there and cannot run.
    """
    return heading_line(flatten(c), bold, font, body_font)


def is_contents_page(c: Column) -> Column:
    """A page that names itself contents and has five lines or more that are bare page numbers."""
    numbers = F.size(F.filter(F.split(c, "\n", -1), lambda x: F.trim(x).rlike(r"^\d{1,3}$")))
    low = F.lower(c)
    return (low.contains("contents") | low.contains("in this report") | low.contains("\nindex")) & (numbers >= 5)


def step(df, name: str, value: Column):
    """``withColumn`` that the optimiser folds into nothing: what is dear and used many times over is worked out once."""
    return df.select(*(c for c in df.columns if c != name), F.explode(F.array(value)).alias(name))


def page_label(start: Column, end: Column) -> Column:
    return F.when(start.isNull() | end.isNull(), "—").when(start == end, start.cast("string")).otherwise(F.concat(start.cast("string"), F.lit("–"), end.cast("string")))


def stage_label(c: Column) -> Column:
    """``retrieval_seconds`` as ``Retrieval``."""
    return F.initcap(F.replace(F.replace(c, F.lit("_seconds"), F.lit("")), F.lit("_"), F.lit(" ")))
