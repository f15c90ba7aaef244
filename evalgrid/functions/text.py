"""Text clean-up and matching as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K_MAX = 12

# Word lists of the phrase splitter, the matcher and the token overlap.
ARTICLES = ["a", "an", "the"]
MATCH_STOP = ["a", "an", "the", "some", "of", "with", "on", "in", "and", "or", "for", "to", "at", "by"]
MATCH_CUT = ["of", "for", "on", "with", "in", "at", "from", "near"]
TOKEN_STOP = ["the", "a", "an", "i", "my", "me", "to", "please", "it", "is", "of", "and", "you"]
PHRASE_STOP = [
    "a", "an", "the", "is", "are", "and", "of", "in", "on", "with", "this",
    "that", "to", "for", "at", "it", "its", "there", "scene", "image",
    "visible", "objects", "areas", "what",
]
BREAK_WORDS = [
    "in front of", "on top of", "next to", "there is", "there are", "and", "with", "on", "in", "at", "near",
    "beside", "under", "behind", "by", "including", "is", "are", "has", "have", "their", "his", "her", "its",
]
LEAD_WORDS = [
    "a", "an", "the", "some", "two", "three", "four", "five", "several", "many", "other", "various", "small", "large",
    "big", "white", "black", "red", "blue", "green", "wooden", "old",
]
ING_NOUNS = [
    "ceiling", "painting", "paintings", "clothing", "building", "buildings", "ring", "rings", "string", "wing", "wings", "bedding",
    "icing", "frosting", "pudding", "dressing", "railing", "lighting", "seating", "flooring", "awning", "earring", "earrings",
    "stuffing", "wedding", "spring", "swing", "king", "thing", "things", "something", "nothing", "everything", "ironing board",
    "sling", "filling", "topping", "toppings", "siding", "molding", "moulding", "outing", "living", "dining", "sewing", "washing", "baking", "cutting",
    "shopping", "rolling", "frying", "sleeping", "running", "walking", "hearing", "reading", "drinking", "changing", "sitting room",
    "dressing table", "mixing", "serving", "measuring", "boxing", "parking", "ping",
]
# Plural suffix -> singular ending, tried in this order.
SINGULAR = [
    ("ies", "y"), ("ves", "f"), ("ves", "fe"), ("oes", "o"), ("ches", "ch"),
    ("shes", "sh"), ("sses", "ss"), ("xes", "x"), ("es", ""), ("s", ""),
]
MAX_PHRASE_WORDS = 4
MAX_LIST_CHARS = 40


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def canon(name: Column) -> Column:
    """Catalogue name to plain words: bracketed part dropped, underscores to spaces, lower case."""
    return F.lower(strip(F.replace(F.regexp_replace(name, r"_?\(.*?\)", ""), F.lit("_"), F.lit(" "))))


def norm_item(c: Column) -> Column:
    """Lower case, letters, digits and single spaces only."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N} ]", ""), " +", " "))


def word_set(c: Column) -> Column:
    """Distinct a-z words without stop words."""
    words = F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)"), F.lit(1))
    return F.array_except(words, F.array(*[F.lit(w) for w in TOKEN_STOP]))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def singular_forms(word: Column) -> Column:
    """Candidate singulars of a word, in suffix order; too short stems are left out."""
    forms = [
        F.when(F.endswith(word, F.lit(s)) & (F.length(word) > len(s) + 1), F.concat(F.substring(word, F.lit(1), F.length(word) - len(s)), F.lit(r)))
        for s, r in SINGULAR
    ]
    return F.array_compact(F.array(*forms))


def keep_first(items: Column, key, k: int = K_MAX) -> Column:
    """First item of each distinct key(item), in order, at most k; one pass over the array."""
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("keys"), none.alias("items"))

    def step(acc: Column, x: Column) -> Column:
        seen = (F.size(acc["keys"]) >= k) | F.array_contains(acc["keys"], key(x))
        grown = F.struct(F.array_append(acc["keys"], key(x)).alias("keys"), F.array_append(acc["items"], x).alias("items"))
        return F.when(seen, acc).otherwise(grown)

    return F.aggregate(items, start, step, lambda acc: acc["items"])


def phrase_items(text: Column) -> Column:
    """Noun phrases of a caption in order, without repeats, at most K_MAX.

    Split at punctuation, function words and -ing verbs (not -ing nouns); leading determiners,
    numbers and plain adjectives go; phrases of more than four words are dropped.
    """
    edge = r"(?:(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_])|(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_]))"  # also beside accented letters
    breaks = rf"[,;.:!?\n]|{edge}(?:{'|'.join(BREAK_WORDS)}){edge}|{edge}(?!(?:{'|'.join(ING_NOUNS)}){edge})[a-z]+ing{edge}"
    lead = "^(?:(?:" + "|".join(LEAD_WORDS) + r"|\d+)\s+)+"
    parts = F.transform(F.split(F.lower(text), breaks), lambda p: strip(F.regexp_replace(strip(F.regexp_replace(p, r"[^a-z\s-]", " ")), lead, "")))
    stop = F.array(*[F.lit(w) for w in PHRASE_STOP])
    good = F.filter(parts, lambda p: (F.length(p) >= 2) & (F.size(F.split(p, r"\s+")) <= MAX_PHRASE_WORDS) & ~F.array_contains(stop, p))
    return F.slice(F.array_distinct(good), 1, K_MAX)


def list_items(text: Column) -> Column:
    """Items of a comma, semicolon or newline separated list without bullets or numbering, at
    most 40 characters each, first spelling of a case-insensitive repeat, at most K_MAX."""
    parts = F.split(text, "[,;\n]")
    clean = F.transform(parts, lambda p: strip(F.regexp_replace(strip(F.regexp_replace(p, r"^\s*(?:\d+[.)]|[-*•])\s*", "")), r"^\.+|\.+$", "")))
    good = F.filter(clean, lambda p: (p != "") & (F.length(p) <= MAX_LIST_CHARS))
    return keep_first(good, F.lower)


def strip_prompt(decoded: Column, prompt: Column) -> Column:
    """Remove an echoed prompt from the front, whatever its case."""
    d = strip(decoded)
    echoed = (F.length(prompt) > 0) & F.startswith(F.lower(d), F.lower(prompt))
    return F.when(echoed, strip(F.substring(d, F.length(prompt) + 1, F.length(d)))).otherwise(d)


def want_sentence(objects: Column) -> Column:
    """I want a, b and c."""
    n = F.size(objects)
    head = F.array_join(F.slice(objects, F.lit(1), F.greatest(n - 1, F.lit(1))), ", ")
    few = F.array_join(objects, " and ")
    return F.concat(F.lit("I want "), F.when(n < 3, few).otherwise(F.concat(head, F.lit(" and "), F.element_at(objects, -1))), F.lit("."))


def ranked_picks(text: Column, n: Column | int) -> Column:
    """1-based numbers named in a text, as distinct in-range zero-based picks in order."""
    n = F.lit(n) if isinstance(n, int) else n
    nums = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1)), lambda s: s.try_cast("bigint") - 1)
    return F.array_distinct(F.filter(nums, lambda i: i.isNotNull() & (i >= 0) & (i < n)))


def match_words(text: Column) -> tuple[Column, Column]:
    """(whole phrase without articles, words kept for trailing phrases) of a free-text item."""
    raw = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^a-z]", " "), " +"), lambda w: w != "")
    whole = F.array_join(F.filter(raw, lambda w: ~w.isin(ARTICLES)), " ")
    cut_at = F.array_min(F.filter(F.transform(raw, lambda w, i: F.when(w.isin(MATCH_CUT) & (i > 0), i)), lambda i: i.isNotNull()))
    head = F.when(cut_at.isNotNull(), F.slice(raw, F.lit(1), F.coalesce(cut_at, F.lit(0)))).otherwise(raw)
    return whole, F.filter(head, lambda w: ~w.isin(MATCH_STOP))
