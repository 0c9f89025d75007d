"""Column functions over answers and conversation texts; all built from native expressions.

A null text counts as empty unless a function says otherwise; functions that find something return null if nothing is found.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# What answers look like and what they say.
LETTERS = "ABCDEFGHIJ"
LETTER_PATTERNS = (r"(?i)\[\[\s*([A-J])\s*\]\]", r"(?i)final answer\s*[:\-]\s*([A-J])\b", r"(?i)\banswer\s*[:\-]\s*([A-J])\b", r"(?i)\boption\s*([A-J])\b", r"(?i)^\s*([A-J])[\).\s:]")
NO_IMAGE = (
    r"\bno image\b", r"\bwithout (any )?image\b", r"\bcannot see (the )?image\b", r"\bcan't see (the )?image\b", r"\bimage (was )?not provided\b",
    r"\bimage\s*\([^)]*\)\s*is not provided\b", r"\bimage(?: itself)?\s*(?:is|was)?\s*not\s+visible(?:\s+in\s+the\s+text)?\b", r"\bno (picture|photo|attachment)\b",
    r"\bmissing image\b", r"\bnot attached\b", r"\bwithout visual (information|input)\b", r"\bi do not have (the )?(ability|capability) to (view|see|interpret) (visual data|images?)\b",
    r"\bi cannot (view|see|interpret) (visual data|images?)\b", r"\bas an ai (assistant|language model).*(cannot|can't|do not have).*(see|view).*(image|visual)\b",
    r"\b没有(提供)?(图片|图像)\b", r"\b未提供(图片|图像)\b", r"\b看不到(图片|图像)\b", r"\b无图像\b",
)
UNCERTAIN = (r"\bnot sure\b", r"\bcannot determine\b", r"\binsufficient information\b", r"\bunable to determine\b", r"\b无法判断\b", r"\b不能判断\b", r"\b不确定\b", r"\b信息不足\b")
YES, NO = ("y", "yes", "true"), ("n", "no", "false")
OPTION_LIST = r"(?m)^\s*(?:[-*]\s*)?(?:[A-E][.)]|\([A-E]\))\s+"
FINAL_BRACKET = r"\[\[\s*([^\]]+?)\s*\]\]"
BENCHMARKS = (
    ("microvqa", ("microvqa", "microscopy image")), ("medxpertqa_mm", ("medxpertqa-mm", "medical professional")),
    ("mmmu_pro", ("mmmu-pro", "multiple academic disciplines")), ("vqa_rad", ("vqa-rad", "radiologist", "radiology image")),
)
#: What stands before a phrase that is part of an answer option.
OPTION_BEFORE = r"(?m)(?<!(?:^|[\s(\[])(?:option\s{0,8})?[a-j][.):]\s{0,8})(?<!^\s{0,8}[-*]\s{0,8}(?:option\s{0,8})?[a-j][.):]\s{0,8})"


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


#: White space of any kind, the characters that ``(?U)\\s`` matches.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space at either end, of any kind."""
    return F.btrim(c, F.lit(BLANKS))


def squeeze(c: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.btrim(F.regexp_replace(text(c), r"(?U)\s+", " "))


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null if there is none or it is empty."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def word_count(c: Column) -> Column:
    return F.size(F.regexp_extract_all(text(c), F.lit(r"(?U)\S+"), F.lit(0)))


def tokens(c: Column) -> Column:
    """Tokens of letters, digits, underscores and square brackets, in lower case."""
    return F.regexp_extract_all(F.lower(text(c)), F.lit(r"[A-Za-z0-9_\[\]]+"), F.lit(0))


def grams(words: Column) -> Column:
    """Distinct single tokens and pairs of neighbours."""
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.concat(words, pairs))


def alphanumerics(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(text(c)), F.lit("[a-z0-9]+"), F.lit(0))


def lettered(options: Column) -> Column:
    """Up to ten options as lines ``A. text``."""
    ten = F.slice(options, 1, 10)
    return F.array_join(F.transform(ten, lambda x, i: F.concat(F.substring(F.lit(LETTERS), i + 1, F.lit(1)), F.lit(". "), x)), "\n")


def option_entries(c: Column) -> Column:
    """Option lines as (key, value); a letter keeps its first place and its last text."""
    pattern = r"(?i)^\s*([A-J])[.):]\s*(.+?)\s*$"
    lines = F.filter(F.transform(F.split(text(c), r"\r\n|[\n\r]"), strip), lambda x: x.rlike(pattern))
    every = F.transform(lines, lambda x: F.struct(F.upper(F.regexp_extract(x, pattern, 1)).alias("key"), strip(F.regexp_extract(x, pattern, 2)).alias("value")))
    keys = F.array_distinct(F.transform(every, lambda e: e["key"]))
    return F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(every, lambda e: e["key"] == k), -1)["value"].alias("value")))


def option_map(c: Column) -> Column:
    return F.map_from_entries(option_entries(c))


def option_letter(answer: Column, options: Column) -> Column:
    """The letter an answer chooses: by one of the patterns, in order, else the first option whose text it contains."""
    own = strip(text(answer))
    by_text = F.filter(option_entries(options), lambda e: (e["value"] != "") & F.contains(F.lower(own), F.lower(e["value"])))
    return F.when(own != "", F.coalesce(*(F.upper(found(own, p)) for p in LETTER_PATTERNS), F.try_element_at(by_text, F.lit(1))["key"]))


def open_answer(answer: Column) -> Column:
    """The answer in brackets, on the final line, the first yes or no, or the first line with text, up to 200 characters."""
    own = strip(text(answer))
    lines = F.filter(F.transform(F.split(own, r"\r\n|[\n\r]"), lambda x: F.btrim(x, F.lit(" -\t"))), lambda x: x != "")
    choices = (F.nullif(strip(F.regexp_extract(own, r"(?s)\[\[\s*(.*?)\s*\]\]", 1)), F.lit("")), F.nullif(strip(F.regexp_extract(own, r"(?i)final answer\s*[:\-]\s*([^\n\r]+)", 1)), F.lit("")), found(own, r"(?i)\b(yes|no)\b"), F.substring(F.try_element_at(lines, F.lit(1)), 1, 200))
    return F.when(own != "", F.coalesce(*choices))


def normal_letter(c: Column) -> Column:
    own = F.upper(strip(c.cast("string")))
    return F.when((own != "") & F.contains(F.lit(LETTERS), own), own)


def normal_open(c: Column) -> Column:
    """Lower case without wrapping marks; synonyms of yes and no become these; other marks go."""
    own = F.lower(strip(c.cast("string")))
    own = F.btrim(strip(F.regexp_replace(own, r"^\[\[|\]\]$", "")), F.lit("\"'`.,;:!?()[]{}"))
    own = F.regexp_replace(own, r"(?U)\s+", " ")
    plain = F.btrim(F.regexp_replace(F.regexp_replace(own, r"[^a-z0-9\s\-/%+]", ""), r"\s+", " "))
    return F.when(own.isin(*YES), "yes").when(own.isin(*NO), "no").otherwise(F.nullif(plain, F.lit("")))


def normal_truth(task: Column, c: Column) -> Column:
    return F.when(task == "mcq", normal_letter(c)).otherwise(normal_open(c))


def agrees(task: Column, letter: Column, true_letter: Column, plain: Column, true_plain: Column) -> Column:
    """Whether a normalised answer is right; null if either side cannot be read. A yes or no needs the start only."""
    free = F.when(plain.isNotNull() & true_plain.isNotNull(), (plain == true_plain) | (true_plain.isin("yes", "no") & plain.startswith(true_plain)))
    return F.when(task == "mcq", letter == true_letter).otherwise(free)


def correct(task: Column, answer: Column, truth: Column) -> Column:
    """Whether a parsed answer is right (``agrees``)."""
    return agrees(task, normal_letter(answer), normal_letter(truth), normal_open(answer), normal_open(truth))


#: Where a word of ASCII letters, digits and underscores begins or ends.
ASCII_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def ascii_edges(pattern: str) -> str:
    r"""``pattern`` with ``\b`` as in RE2: words are ASCII, any other letter ends them. What Java takes for a word differs by its version."""
    return re.sub(r"\\(.)", lambda m: ASCII_EDGE if m[1] == "b" else f"(?!{ASCII_EDGE})" if m[1] == "B" else m[0], pattern, flags=re.DOTALL)


def mentions(c: Column, patterns: Sequence[str], in_options: bool = False, ascii_words: bool = False) -> Column:
    """Whether one of the patterns occurs, in lower case, outside an answer option (``in_options``: anywhere).

    ``ascii_words``: the patterns' words end at any letter outside ASCII (``ascii_edges``).
    """
    own = F.lower(text(c))
    hit = F.lit(False)
    for p in _merged(list(map(ascii_edges, patterns)) if ascii_words else list(patterns)):
        # the pattern first: what stands before it is looked at only where it matches
        hit = hit | own.rlike(p if in_options else f"(?=(?:{p})){OPTION_BEFORE}")
    return hit


def _merged(patterns: list[str]) -> list[str]:
    """``patterns`` as branches of one, so that a text is lowered and decoded once; those that refer to groups by number or name stay alone."""
    alone = [p for p in patterns if re.search(r"\\[1-9k]|\(\?<[A-Za-z]", p)]
    many = [f"(?:{p})" for p in patterns if p not in alone]
    return (["|".join(many)] if many else []) + alone


def reasoning(c: Column) -> Column:
    """What stands between think tags; null without them."""
    return F.when(c.rlike("(?is)<think>(.*?)</think>"), strip(F.regexp_extract(c, "(?is)<think>(.*?)</think>", 1)))


def prompt(question: Column, options: Column) -> Column:
    """Question and options; a null question leaves the options, and null without any."""
    own = strip(text(options))
    return F.when(question.isNull(), F.nullif(own, F.lit(""))).when(own != "", F.concat(question, F.lit("\n\n"), own)).otherwise(question)


def final_answer(c: Column) -> Column:
    """The last text in double brackets, squeezed, up to 40 characters; empty if there is none."""
    every = F.regexp_extract_all(text(c), F.lit(FINAL_BRACKET), F.lit(1))
    return F.coalesce(F.substring(squeeze(F.try_element_at(every, F.lit(-1))), 1, 40), F.lit(""))


def has_options(c: Column) -> Column:
    return text(c).rlike(OPTION_LIST)


def has_bracket(c: Column) -> Column:
    return text(c).rlike(FINAL_BRACKET)


def says(c: Column, phrase: Column, whole_words: bool = False) -> Column:
    """Whether the squeezed lower-case text contains the phrase; ``whole_words`` wants blanks or ends around it."""
    own = F.lower(squeeze(c))
    return F.contains(F.concat(F.lit(" "), own, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" "))) if whole_words else F.contains(own, phrase)


def target_token(task: Column, truth: Column) -> Column:
    """The option letter, or the first word of an open answer without marks around it."""
    words = F.filter(F.transform(F.split(strip(text(truth)), r"(?U)\s+"), lambda w: F.btrim(w, F.lit("\"'`.,;:!?()[]{}"))), lambda w: w != "")
    return F.when(task == "mcq", normal_letter(truth)).otherwise(F.try_element_at(words, F.lit(1)))


def benchmark(system_prompt: Column) -> Column:
    own = F.lower(text(system_prompt))
    named = F.lit(None).cast("string")
    for name, marks in reversed(BENCHMARKS):
        hit = F.lit(False)
        for m in marks:
            hit = hit | F.contains(own, F.lit(m))
        named = F.when(hit, F.lit(name)).otherwise(named)
    return F.coalesce(named, F.lit("unknown"))


def answer_kind(answer: Column) -> Column:
    """CLOSED for a yes or no, else OPEN."""
    return F.when(F.lower(F.btrim(text(answer))).isin("yes", "no"), "CLOSED").otherwise("OPEN")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def yes_no(answer: Column) -> Column:
    """yes or no for their synonyms, with or without full stops behind; null for other answers."""
    own = F.rtrim(F.lower(strip(text(answer))), F.lit("."))
    return F.when(own.isin(*YES), "yes").when(own.isin(*NO), "no")


def split_of(path: Column, stated: Column | None = None) -> Column:
    """train or test: what a row states, else the folder of that name in its path, else test; another word counts as test."""
    lower = F.lower(path)
    by_path = F.when(lower.contains("/train/"), "train").when(lower.contains("/test/"), "test")
    own = F.coalesce(F.nullif(F.lower(stated), F.lit("")), by_path) if stated is not None else by_path
    return F.when(own == "train", "train").otherwise("test")


def question_kinds(answer: Column, split: Column) -> dict[str, Column]:
    """``answer`` (yes and no in one form), ``answer_type``, ``question_type`` and ``phrase_type`` of a question."""
    own = yes_no(answer)
    closed = own.isNotNull()
    return {"answer": F.coalesce(own, strip(text(answer))), "answer_type": F.when(closed, "CLOSED").otherwise("OPEN"), "question_type": F.when(closed, "binary").otherwise("open"), "phrase_type": F.when(split == "test", "test_para").otherwise("para")}


def image_name(hint: Column, index: Column, stem: str = "image") -> Column:
    """The file name of the hint, else a name with a padded number."""
    return F.coalesce(F.nullif(file_name(hint), F.lit("")), F.concat(F.lit(f"{stem}_"), F.lpad(index.cast("string"), 6, "0"), F.lit(".jpg")))


def mime(data: Column) -> Column:
    """The type of an image by its first bytes."""
    head = F.hex(F.substring(data, 1, 12))
    return F.when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("89504E470D0A1A0A"), "image/png").when(head.startswith("47494638"), "image/gif").when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp").when(head.startswith("424D"), "image/bmp").otherwise("image/jpeg")


def data_url(data: Column) -> Column:
    return F.concat(F.lit("data:"), mime(data), F.lit(";base64,"), F.base64(data))


def rewrites(output: Column, question: Column, n: int) -> Column:
    """The first ``n`` rewrites a model put out: JSON (fenced or not), else lines without numbers and bullets.

    Repeats and the question itself go; too few are filled up with rewrites by rule.
    """
    raw = strip(text(output))
    fenced = F.try_element_at(F.split(raw, "```"), F.lit(2))
    raw = F.when(F.contains(raw, F.lit("```")), strip(F.regexp_replace(fenced, "(?i)^json", ""))).otherwise(raw)
    shape = "struct<mutations:array<string>>"
    parsed = F.coalesce(F.from_json(raw, shape)["mutations"], F.from_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0), shape)["mutations"])
    parsed = F.filter(F.transform(parsed, strip), lambda m: m != "")
    lines = F.filter(F.transform(F.split(raw, r"\r\n|[\n\r]"), lambda x: F.regexp_replace(F.regexp_replace(strip(x), r"^\d+[).\-\s]+", ""), r"^[-*]\s+", "")), lambda m: m != "")
    own = F.when(F.coalesce(F.size(parsed), F.lit(0)) > 0, parsed).otherwise(lines)
    low = F.concat(F.lower(F.left(question, F.lit(1))), F.right(question, F.length(question) - 1))
    swap = lambda a, b: F.when(F.contains(question, F.lit(a)), F.regexp_replace(question, f"^(?s)(.*?){a}", f"$1{b}")).otherwise(question)
    rules = F.array(
        F.concat(F.lit("Please "), low), F.concat(question, F.lit(" Please answer briefly.")),
        F.when(F.contains(question, F.lit("What")), swap("What", "Which")).otherwise(F.concat(F.lit("Which "), low)),
        swap("How many", "Approximately how many"), swap("Is there", "Do you see"), F.concat(F.lit("In this image, "), low),
    )
    distinct = lambda a: F.array_except(F.array_distinct(F.transform(a, strip)), F.array(strip(question)))
    first = F.slice(distinct(rules), 1, n)
    fill = F.concat(first, F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(question, F.lit(" (rephrased "), (i + F.size(first)).cast("string"), F.lit(")"))))
    return F.slice(F.array_distinct(F.concat(F.slice(distinct(own), 1, n), F.slice(fill, 1, n))), 1, n)


# Names of activation features.
def layer(name: Column) -> Column:
    return F.regexp_extract(name, r"layer_(\d+)", 1).try_cast("int")


def head(name: Column) -> Column:
    return F.regexp_extract(name, r"attention_head_(\d+)", 1).try_cast("int")


def strategy(name: Column) -> Column:
    return F.when(F.contains(name, F.lit("__")), F.element_at(F.split(name, "__"), -1)).otherwise("")


def family(name: Column) -> Column:
    """concat, attention (a head), post_attention, mlp or residual."""
    return F.when(F.contains(name, F.lit("all_layers_concat")), "concat").when(F.contains(name, F.lit("attention_head_")), "attention").when(F.contains(name, F.lit("/post_attention")), "post_attention").when(F.contains(name, F.lit("/mlp")), "mlp").when(F.contains(name, F.lit("layer_")), "residual").otherwise("unknown")


def candidates(layers: Column, strategies: Sequence[str]) -> Column:
    """The feature names to try: every layer's residual, mlp and post-attention part and all layers together, for each strategy."""
    own = F.transform(layers, lambda k: F.concat(F.lit("language_model/layer_"), k.cast("string")))
    parts = F.flatten(F.transform(own, lambda stem: F.array(*(F.concat(stem, F.lit(t)) for t in ("", "/mlp", "/post_attention")))))
    stems = F.concat(parts, F.array(F.lit("language_model/all_layers_concat"), F.lit("language_model/attention_all")))
    return F.flatten(F.transform(stems, lambda stem: F.array(*(F.concat(stem, F.lit(f"__{s}")) for s in strategies))))


# Cells of result tables.
def number(*candidates: Column) -> Column:
    """The first candidate that is a number."""
    return F.coalesce(*(c.cast("string").try_cast("double") for c in candidates))


def percent(c: Column) -> Column:
    return F.when(c.isNotNull(), F.format_string("%.2f%%", c * 100)).otherwise("N/A")


def signed_percent(c: Column) -> Column:
    return F.when(c.isNotNull(), F.format_string("%+.1f%%", c * 100)).otherwise("N/A")


def cell(c: Column, parts: Column | None = None) -> Column:
    """A percentage, and in brackets those of its parts."""
    if parts is None:
        return percent(c)
    inner = F.array_join(F.transform(parts, percent), ", ")
    return F.when(F.coalesce(F.size(parts), F.lit(0)) > 0, F.concat(percent(c), F.lit(" ("), inner, F.lit(")"))).otherwise(percent(c))
