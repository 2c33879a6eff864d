"""Column functions on text.

All of them return null for a null text unless they say otherwise, and take texts of any length.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, and the characters of Chinese text, as members of a character class (fixed values).
WHITE = " \\t\\n\\x0B\\f\\r\\x1C-\\x1F\\x85\\xA0\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
CJK = "一-鿿"
#: Full-width marks and what stands for them in comparisons (fixed values).
FULL_WIDTH, HALF_WIDTH = "，。；：（）【】“”‘’　", ",.;:()[]\"\"'' "


def given(value: Column, body) -> Column:
    """``body`` of a value that is computed once, though the body may use it in every step of a loop over an array."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def grams(text: Column, n: int) -> Column:
    """Character n-grams in order, repeats kept; none for shorter texts."""

    def cut(t: Column) -> Column:
        last = F.length(t) - n + 1
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(t, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return given(text, cut)


def _segments(low: Column) -> Column:
    return F.regexp_extract_all(low, F.lit(f"([a-z0-9_]+|[{CJK}]+)"), F.lit(1))


def _tokens(text: Column, of_cjk) -> Column:
    low = F.lower(text)
    one = lambda s: F.when(s.rlike("^[a-z0-9_]"), F.when(F.length(s) >= 2, F.array(s)).otherwise(F.array().cast("array<string>"))).otherwise(of_cjk(s))
    words = F.regexp_extract_all(low, F.lit("([a-z0-9_]{2,})"), F.lit(1))  # the same, and cheaper, where there is no CJK
    return F.when(low.rlike(f"[{CJK}]"), F.flatten(F.transform(_segments(low), one))).otherwise(words)


def lexical_tokens(text: Column) -> Column:
    """Lower-cased words of two or more of a-z, 0-9 and underscore, and bigrams and trigrams of CJK runs (a single character is itself), repeats kept."""
    return _tokens(text, lambda s: F.when(F.length(s) == 1, F.array(s)).otherwise(F.concat(grams(s, 2), grams(s, 3))))


def quality_tokens(text: Column) -> Column:
    """Set of such words and of bigrams of CJK runs; runs of up to two characters are whole."""
    return F.array_distinct(_tokens(text, lambda s: F.when(F.length(s) <= 2, F.array(s)).otherwise(grams(s, 2))))


def language_of(text: Column, share: float = 0.05) -> Column:
    """zh where more than ``share`` of the characters are CJK, else en by Latin letters, else unknown."""
    size = F.greatest(F.length(text), F.lit(1))
    cjk = F.length(text) - F.length(F.regexp_replace(text, f"[{CJK}]", ""))
    latin = F.length(text) - F.length(F.regexp_replace(text, "[A-Za-z]", ""))
    return F.when(cjk / size > share, "zh").when(latin / size > share, "en").otherwise("unknown")


def strip(text: Column) -> Column:
    """Without white space, of any kind, at the ends."""
    return F.regexp_replace(text, f"^[{WHITE}]+|[{WHITE}]+$", "")


def collapse(text: Column) -> Column:
    """White space runs made one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, f"[{WHITE}]+", " "))


def compact(text: Column) -> Column:
    """Lower case without any white space."""
    return F.regexp_replace(F.lower(text), f"[{WHITE}]+", "")


def normalised(text: Column) -> Column:
    """Lower case, white space collapsed, only letters and digits of any script, underscores and blanks kept."""
    return F.trim(F.regexp_replace(collapse(F.lower(text)), r"[^\p{L}\p{N}_ ]+", ""))


def metric_tokens(text: Column) -> Column:
    """Parts between white space; the characters of a text that has none inside. Null and blank texts have none."""
    t = strip(F.coalesce(text, F.lit("")))
    parts = F.when(t.rlike(f"[{WHITE}]"), F.split(t, f"[{WHITE}]+")).otherwise(F.split(t, ""))
    return F.filter(parts, lambda x: x != "")


def grounding_form(text: Column) -> Column:
    """For comparisons of facts: full-width marks as ASCII, lower case, no white space; null is empty."""
    return compact(F.translate(F.coalesce(text, F.lit("")), FULL_WIDTH, HALF_WIDTH))


def anchor_form(text: Column) -> Column:
    """Lower case, only ASCII letters, digits and CJK; null is empty."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"[^0-9a-z{CJK}]", "")


def clean_lines(text: Column) -> Column:
    """Line ends made line feeds, full-width blanks made spaces."""
    return F.translate(F.regexp_replace(text, "\r\n?", "\n"), "　", " ")


def without_blank_runs(text: Column) -> Column:
    """At most one blank line in a row, none at the ends; ends of lines trimmed."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[ \t]+(?=\n|$)", ""), "\n{3,}", "\n\n"), "^\n+|\n+$", "")


def sentences(text: Column, least: int = 1, most: int | None = None) -> Column:
    """Sentences with their closing marks, Western or Chinese, trimmed, of ``least`` to ``most`` characters."""
    parts = F.transform(F.regexp_extract_all(text, F.lit("([^.!?;。！？；]+[.!?;。！？；]*)"), F.lit(1)), collapse)
    return F.filter(parts, lambda x: (F.length(x) >= least) & (F.lit(True) if most is None else F.length(x) <= most))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two arrays taken as sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def terms(text: Column) -> Column:
    """Terms between commas, semicolons and line ends, Western or Chinese, trimmed; of terms that differ in case only the first."""
    parts = F.filter(F.transform(F.split(text, "[,，;；\n]+"), strip), lambda x: x != "")
    low = F.transform(parts, F.lower)
    return given(low, lambda every: F.filter(parts, lambda x, i: F.array_position(every, F.lower(x)) == i + 1))


def title_parts(path: Column) -> Column:
    """Parts of a title path that is joined by '>' or its full-width form; none for null."""
    return F.filter(F.transform(F.split(F.coalesce(path, F.lit("")), "[>＞]"), strip), lambda x: x != "")


def parent_title(path: Column) -> Column:
    """The title path without its last part; empty for one part or none."""
    parts = title_parts(path)
    return F.when(F.size(parts) < 2, "").otherwise(F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), " > "))


def slug(title: Column) -> Column:
    """Anchor of a heading: lower case, blanks made hyphens, other marks dropped, no hyphens in a row or at the ends."""
    kept = F.regexp_replace(F.regexp_replace(F.lower(title), f"[{WHITE}]+", "-"), r"[^\p{L}\p{N}_-]", "")
    return F.regexp_replace(F.regexp_replace(kept, "-+", "-"), "^-|-$", "")


def safe_name(name: Column, most: int = 120, default: str = "file") -> Column:
    """File name of ASCII letters, digits, dots, hyphens and single underscores, of ``most`` characters; ``default`` if nothing is left."""
    kept = F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9._-]", "_"), "_+", "_")
    kept = F.substring(F.regexp_replace(kept, "^[_.]+|[_.]+$", ""), 1, most)
    return F.when(F.coalesce(kept, F.lit("")) == "", default).otherwise(kept)


def stem(path: Column) -> Column:
    """File name without folders and its last extension."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name)


def with_extension(path: Column, extension: str) -> Column:
    """The file name with another extension."""
    return F.concat(stem(path), F.lit(extension))


def decoded_escapes(text: Column) -> Column:
    """Written-out \\n, \\t and \\r made what they stand for."""
    for mark, char in (("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r")):
        text = F.replace(text, F.lit(mark), F.lit(char))
    return text


def cut_bytes(text: Column, most: int) -> Column:
    """The longest prefix of whole characters that has at most ``most`` UTF-8 bytes."""
    raw = F.substring(text.cast("binary"), 1, most)
    ends = lambda k: F.substring(text.cast("binary"), 1, most - k)
    # a character has four bytes at most: the first of four cuts that decodes is the longest
    whole = F.coalesce(*[F.try_validate_utf8(ends(k).cast("string")) if k else F.try_validate_utf8(raw.cast("string")) for k in range(min(4, most + 1))])
    return F.when(F.octet_length(text) <= most, text).otherwise(whole)


def excerpt(text: Column, most: int = 900) -> Column:
    """The text, or its two ends joined by dots where it is longer than ``most``."""
    half = most // 2
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, half), F.lit("..."), F.right(text, F.lit(half))))


#: Marks of Markdown and what stands for them, in this order.
MARKS = (
    ("<[^<>\n]+>", ""), ("(?m)^#{1,6}[ \\t]+", ""), ("(?m)^>[ \\t]?", ""), ("!\\[([^\\]]*)\\]\\([^)]*\\)", "{1}"), ("\\[([^\\]]*)\\]\\([^)]*\\)", "{1}"),
    ("[*]{2}([^*\n]+)[*]{2}", "{1}"), ("[*]([^*\n]+)[*]", "{1}"), ("`([^`\n]*)`", "{1}"), ("[ \\t]+\n", "\n"), ("\n{3,}", "\n\n"),
)


def without_markdown(text: Column) -> Column:
    """Text without tags and the marks of headings, quotes, images, links, bold, italics and code, and with single blank lines."""
    for pattern, put in MARKS:
        text = F.regexp_replace(text, pattern, put.replace("{1}", "$1"))
    return text


#: What the label of a source looks like: articles, chapters, numbered parts and appendices (fixed values).
SOURCE_LABELS = "(第[一二三四五六七八九十百零0-9]+[条章节段]|附件[一二三四五六七八九十0-9]+|[一二三四五六七八九十]+、|(?i:Article|Section|Chapter|Rule) [0-9IVX]+)"


def labels_with_places(text: Column) -> Column:
    """Array of label, place (from 1) of every source label, in order."""

    def placed(t: Column) -> Column:
        gaps, labels = F.split(t, SOURCE_LABELS, -1), F.regexp_extract_all(t, F.lit(SOURCE_LABELS), F.lit(1))
        start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<label:string,place:int>>").alias("out"))
        step = lambda s, x: F.struct(
            (s["at"] + F.length(x["gap"]) + F.length(x["label"])).alias("at"),
            F.array_append(s["out"], F.struct(x["label"].alias("label"), (s["at"] + F.length(x["gap"])).alias("place"))).alias("out"),
        )
        pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(labels)), labels, lambda g, x: F.struct(g.alias("gap"), x.alias("label")))
        return F.aggregate(pairs, start, step, lambda s: s["out"])

    return given(text, placed)


def source_label(text: Column, at: Column) -> Column:
    """The last source label that begins at or before the character ``at`` (from 1) of the text; null if there is none."""
    return F.try_element_at(F.filter(labels_with_places(text), lambda x: x["place"] <= at), F.lit(-1))["label"]


def source_of_fact(text: Column, fact: Column) -> Column:
    """Which label of a text a fact belongs to: the first that the fact names, else the last that begins at or before the fact's place, else the text's only one; null otherwise.

    A label that comes twice counts where it comes first. A blank or null fact has only the last of these.
    """

    def chosen(labels: Column) -> Column:
        first = F.filter(labels, lambda x, i: ~F.exists(F.slice(labels, F.lit(1), i), lambda y: y["label"] == x["label"]))
        clean = strip(F.coalesce(fact, F.lit("")))
        named = F.try_element_at(F.filter(first, lambda x: F.contains(clean, x["label"])), F.lit(1))["label"]
        at = F.instr(text, clean)
        before = F.try_element_at(F.filter(first, lambda x: x["place"] <= at), F.lit(-1))["label"]
        only = F.when(F.size(first) == 1, first[0]["label"])
        return F.coalesce(F.when(clean != "", F.coalesce(named, F.when(at > 0, before))), only)

    return given(labels_with_places(text), chosen)


def first_filled(*columns: Column) -> Column:
    """The first text that is not blank, trimmed; null if there is none."""
    return F.coalesce(*[F.nullif(strip(c.cast("string")), F.lit("")) for c in columns])


#: The division of an image that a scan leaves in the text, and the reference that stands for it.
IMAGE_DIV = r'<div[^>]*>\s*<img[^>]*src="[^"]*?([^"/]+?)(?:\.[A-Za-z0-9]+)?"[^>]*/?>\s*</div>'
IMAGE_REF = r"\[\[IMAGE_REF:([^\]]+)\]\]"


def images_marked(text: Column) -> Column:
    """Image divisions replaced by references to the image's file stem; those of seals dropped."""
    text = F.regexp_replace(text, r'<div[^>]*>\s*<img[^>]*src="[^"]*seal[^"]*"[^>]*/?>\s*</div>', "")
    return F.regexp_replace(text, IMAGE_DIV, "[[IMAGE_REF:$1]]")


def image_refs(text: Column) -> Column:
    """Referenced images, in order."""
    return F.regexp_extract_all(text, F.lit(IMAGE_REF), F.lit(1))


def around_image(text: Column, image: Column, reach: int) -> Column:
    """Struct before, after: ``reach`` characters on either side of an image's first reference, other references removed."""
    mark = F.concat(F.lit("[[IMAGE_REF:"), image, F.lit("]]"))
    clean = lambda c: F.regexp_replace(c, IMAGE_REF, "")
    at = F.instr(text, mark)
    before = F.right(clean(F.substring(text, F.lit(1), at - 1)), F.lit(reach))
    after = F.substring(clean(F.substring(text, at + F.length(mark), F.length(text))), 1, reach)
    return F.when(at > 0, F.struct(before.alias("before"), after.alias("after")))
