"""Text expressions: every function takes and returns Columns, so that they stay inside Spark's own operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values

QUESTION_STOPS = (
    "what", "the", "is", "are", "was", "were", "does", "did", "do", "how", "when", "where", "why", "which", "who", "this", "that", "for", "with",
    "from", "have", "has", "should", "would", "could", "can", "will", "been", "being", "into", "about", "your", "any", "all", "and", "or", "not",
    "but", "of", "in", "on", "at", "to", "an", "explain", "describe", "tell", "show", "give", "please", "detail", "detailed",
)
BASELINE_GENERIC = (
    "automatic", "machine", "manual", "equipment", "device", "system", "document", "procedure", "process", "overview", "instruction", "instructions",
    "operation", "operations", "guide", "section", "chapter", "content",
)
TITLE_SKIP = (
    "pdf", "mp4", "doc", "docx", "xlsx", "pptx", "file", "page", "copy", "draft", "final", "rev", "version", "img", "image", "video",
)
OVERLAP_STOPS = (
    "a", "an", "the", "is", "are", "was", "were", "to", "of", "in", "on", "for", "and", "or", "with", "by", "what", "who", "which", "when", "where",
    "why", "how", "does", "do", "did", "be", "as", "at", "from", "that", "this", "it", "into",
)
SUFFIXES = (
    "ization", "isation", "ational", "ating", "ation", "ments", "ment", "ingly", "ness", "able", "ible", "ized", "ised", "izer", "iser", "ical",
    "ally", "ing", "ers", "ies", "ied", "ed", "es", "s",
)
CAPTION_STOPS = (
    "the", "and", "for", "with", "from", "show", "please", "about", "what", "how", "when", "where", "machine", "manual", "diagram", "image",
    "images", "picture", "pictures", "figure",
)
GENERIC_ALT = ("image", "img", "picture", "figure")
BAD_CAPTIONS = ("image", "img", "picture", "figure", "user's manual", "users manual", "user manual", "manual", "our superior")
BAD_CAPTION_PATTERN = r"(?i)<!--\s*page\s+break\s*-->|!\[[^\]]*\]\(\s*data:image/|\bdata:image/[a-z0-9.+-]+;base64,|\b(?:www\.|https?://|\.com\b|\.net\b|\.org\b)"
NOISE_PATTERN = r"(?i)iso\s*9001|quality\s+management\s+system|about\s+this\s+document|desktop\s+computer|minimum\s+requirement|ergonomic|keyboard\s+and\s+mouse|limitations?\s+of\s+warranty|registered\s+trademarks"
TECH_PATTERN = r"(?i)voltage|vac|vdc|troubleshoot|indicator|12\s*v|24\s*v|power\s+supply|lamp\s+module|fuse|wiring|specification|rated\s+input|green|wall\s+outlet|figure"
MODEL_SECTION = r"(?i)^model\b"
SPEC_SECTION = r"(?i)technical\s+parameters?|specifications?|specs?\b"
GENERIC_SECTION = r"(?i)how\s+to\s+use|operation\s+manual$|^content$|^overview$|^user'?s?\s+manual$"
DISCLAIMERS = (
    "does not provide information, not specified in the provided context",
    "the document does not provide information",
    "not specified in the provided context",
    "not found in the provided context",
    "is not mentioned in the provided context",
    "cannot be determined from the provided context",
    "this section does not provide details",
    "does not provide details on",
    "end of answer",
)
NEGATIVE_LINE = (
    r"(?i)\b((the\s+)?document\s+does\s+not\s+provide|does\s+not\s+provide\s+(steps|details|information|instructions)|does\s+not\s+mention"
    r"|not\s+specified\s+in\s+the\s+provided\s+context|not\s+found\s+in\s+the\s+provided\s+context|cannot\s+be\s+determined\s+from\s+the\s+provided\s+context)\b"
)
HINGLISH = (
    "kya", "kyun", "kyunki", "kaise", "kahan", "kab", "kaun", "kitna", "kitni", "kitne", "hai", "hain", "hota", "hoti", "hote", "ho", "hoga", "hua",
    "ka", "ke", "ki", "ko", "se", "mein", "main", "me", "aur", "ya", "par", "lekin", "batao", "batana", "samjhao", "karo", "kar", "karna", "de",
    "do", "nahi", "nhi", "na", "chahiye", "machine", "manual", "alarm", "reset", "dimension", "rating", "specification",
)
HINGLISH_TRIGGERS = (
    "kya", "kaise", "kitna", "kitni", "kitne", "hota", "hoti", "hai", "ka", "ki", "ko", "aur",
)
SYNONYMS = (
    ("suction", "suck", "sucking", "vacuum", "vacuo"),
    ("form", "forming", "formed", "unformed", "former"),
    ("carton", "cartoning", "cartons"),
    ("adjust", "adjusting", "adjustment"),
    ("height", "high", "lower", "raise"),
    ("bolt", "bolts", "hexagon", "hex"),
)

PAGE_BREAK = "<!-- page break -->"
#: The characters that a plain strip takes for white space.
WHITE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

# ---------------------------------------------------------------- basics


def words(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def text_of(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def pystrip(c: Column) -> Column:
    """Strip all Unicode white space, not blanks only."""
    return F.btrim(c, F.lit(WHITE))


def squeeze(c: Column) -> Column:
    return pystrip(F.regexp_replace(c, r"\s+", " "))


def lines(c: Column) -> Column:
    return F.split(c, r"\r\n|\r|\n")


def first_of(array: Column) -> Column:
    return F.get(array, F.lit(0))


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def contains_any(c: Column, needles) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(n)) for n in needles])


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


# ---------------------------------------------------------------- Markdown and headings


def strip_embedded_images(md: Column) -> Column:
    """Data-URI images become their own line of alt text, or a break where it says nothing; then white space is tidied."""
    generic = F.regexp_replace(md, r"(?i)!\[\s*(?:image|img|picture|figure)?\s*\]\(\s*data:image/[^)]*\)", "\n")
    named = F.regexp_replace(generic, r"(?i)!\[\s*([^\]]*?)\s*\]\(\s*data:image/[^)]*\)", "\n$1\n")
    bare = F.regexp_replace(named, r"(?i)data:image/[a-z0-9.+-]+;base64,[A-Za-z0-9+/=]+", "\n")
    without = F.when(F.rlike(md, F.lit("(?i)data:image/")), bare).otherwise(md)  # most texts have none: one pass instead of three
    return pystrip(F.regexp_replace(F.regexp_replace(without, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))


def first_heading(text: Column) -> Column:
    """The first line that starts with ``#``, without its marks unless nothing else is on it; else empty."""
    line = first_of(F.filter(F.transform(lines(text), pystrip), lambda x: F.startswith(x, F.lit("#"))))
    bare = lambda x: F.coalesce(F.nullif(pystrip(F.regexp_replace(x, "^#+", "")), F.lit("")), x, F.lit(""))
    return F.when(F.contains(text, F.lit("#")), bind(line, bare)).otherwise("")


def first_line_plain(text: Column) -> Column:
    line = F.substring_index(F.regexp_replace(text, r"^[\s\p{Z}]+", ""), "\n", 1)
    return F.lower(pystrip(F.regexp_replace(pystrip(line), r"^#+\s*", "")))


def embedding_text(heading: Column, content: Column) -> Column:
    """Content with its heading in front, unless it starts with it."""
    same = F.lower(pystrip(heading)) == first_line_plain(content)
    return F.when((heading == "") | same, content).otherwise(F.concat(heading, F.lit("\n\n"), content))


def is_table(content: Column) -> Column:
    return F.contains(content, F.lit("|")) & F.contains(content, F.lit("---"))


def section_list(path: Column, path_str: Column) -> Column:
    kept = F.filter(F.transform(F.coalesce(path, F.array().cast("array<string>")), pystrip), lambda x: x != "")
    single = pystrip(text_of(path_str))
    return F.when(F.size(kept) > 0, kept).when(single != "", F.array(single)).otherwise(F.array().cast("array<string>"))


def clean_caption_line(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.regexp_replace(pystrip(c), r"^#+\s*", ""), r"^\*\*|\*\*$", ""))


def flatten_table(rows: Column) -> Column:
    """Rows of cells as Markdown lines, a separator as wide as the first row below it; blank cells go."""
    trimmed = F.filter(F.transform(rows, lambda r: F.filter(F.transform(r, lambda c: pystrip(F.coalesce(c, F.lit("")))), lambda c: c != "")), lambda r: F.size(r) > 0)
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(first_of(trimmed), lambda _: F.lit("---")), " | "), F.lit(" |"))
    out = F.flatten(F.transform(trimmed, lambda r, i: F.when(i == 0, F.array(line(r), rule)).otherwise(F.array(line(r)))))
    return F.array_join(out, "\n")


# ---------------------------------------------------------------- names, pages, captions


def safe_name(c: Column, default: str) -> Column:
    kept = F.regexp_replace(F.regexp_replace(pystrip(text_of(c)), r"[^\p{L}\p{N}_.-]", "_"), r"^[._]+|[._]+$", "")
    return F.when(kept == "", F.lit(default)).otherwise(kept)


def slug(c: Column, default: str) -> Column:
    kept = F.regexp_replace(F.regexp_replace(F.regexp_replace(pystrip(text_of(c)), r"\s+", "_"), r"[^A-Za-z0-9_.-]", "_"), r"^[._]+|[._]+$", "")
    return F.when(kept == "", F.lit(default)).otherwise(kept)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def doc_name_of(name: Column, path: Column) -> Column:
    return F.coalesce(F.nullif(pystrip(name), F.lit("")), F.nullif(base_name(path), F.lit("")), F.lit(""))


def parse_page(c: Column) -> Column:
    """A positive page number: an integer as such, else the first run of digits."""
    whole = c.try_cast("bigint")
    digits = F.regexp_extract(c.cast("string"), r"\d+", 0).try_cast("bigint")
    return F.when(whole.isNotNull(), F.when(whole > 0, whole)).otherwise(F.when(digits > 0, digits))


def parse_chunk_index(c: Column) -> Column:
    whole = c.try_cast("bigint")
    return F.when(whole >= 0, whole)


def source_page(*candidates: Column) -> Column:
    return F.coalesce(*[parse_page(c) for c in candidates])


def is_bad_caption(c: Column) -> Column:
    flat = squeeze(text_of(c))
    return (flat == "") | F.lower(flat).isin(*BAD_CAPTIONS) | F.rlike(flat, F.lit(BAD_CAPTION_PATTERN))


def clean_image_caption(c: Column) -> Column:
    no_links = F.regexp_replace(text_of(c), r"(?i)!\[[^\]]*\]\(\s*data:image/[^)]*\)", " ")
    return squeeze(F.regexp_replace(no_links, r"(?i)data:image/[a-z0-9.+-]+;base64,[A-Za-z0-9+/=\s]+", " "))


def has_text_layer(c: Column) -> Column:
    return F.rlike(text_of(c), F.lit(r"[\p{L}\p{N}]"))


# ---------------------------------------------------------------- tokens


def bm25_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(text_of(c)), F.lit("[a-z0-9]+"), F.lit(0))


def without(tokens: Column, stops) -> Column:
    """Tokens that are not stop words, repeats kept."""
    stop = words(stops)
    return F.filter(tokens, lambda t: ~F.array_contains(stop, t))


def lexical_terms(c: Column, generic=BASELINE_GENERIC) -> Column:
    found = F.regexp_extract_all(F.lower(text_of(c)), F.lit("[a-z]{3,}"), F.lit(0))
    return without(found, [*QUESTION_STOPS, *generic])


def stem(token: Column) -> Column:
    """The first listed suffix that leaves four letters goes; short tokens stay; single letters vanish."""
    n = F.char_length(token)
    out = token
    for suffix in reversed(SUFFIXES):
        fits = F.endswith(token, F.lit(suffix)) & (n - len(suffix) >= 4)
        out = F.when(fits, F.substring(token, F.lit(1), n - len(suffix))).otherwise(out)
    return F.when(n < 2, F.lit("")).when(n <= 4, token).otherwise(out)


def overlap_tokens(c: Column) -> Column:
    stemmed = F.transform(without(bm25_tokens(c), OVERLAP_STOPS), stem)
    return without(F.filter(stemmed, lambda t: F.char_length(t) >= 2), OVERLAP_STOPS)


def caption_keywords(c: Column) -> Column:
    return F.array_distinct(without(F.filter(bm25_tokens(c), lambda t: F.char_length(t) >= 3), CAPTION_STOPS))


def synonym_group(token: Column) -> Column:
    """The token, or the first word of its synonym group."""
    out = token
    for group in SYNONYMS:
        out = F.when(token.isin(*group), F.lit(group[0])).otherwise(out)
    return out


def title_tokens(doc_name: Column, section: Column) -> Column:
    """Tokens of the file's stem and of the section: three characters or more, not all digits, not in the skip list."""
    name = base_name(text_of(doc_name))
    stem_ = F.regexp_replace(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), r"[()\[\]_\-]+", " ")
    both = F.concat(bm25_tokens(stem_), bm25_tokens(section))
    return F.filter(without(both, TITLE_SKIP), lambda t: (F.char_length(t) >= 3) & ~F.rlike(t, F.lit("^[0-9]+$")))


def normalize_section(c: Column) -> Column:
    s = F.regexp_replace(F.lower(pystrip(text_of(c))), r"^#+\s*", "")
    s = F.regexp_replace(F.regexp_replace(s, r"^[ivxlc]+\.\s*", ""), r"[^a-z0-9\s]", " ")
    return squeeze(s)


# ---------------------------------------------------------------- score multipliers


def thin_chunk(text: Column) -> Column:
    n = F.char_length(pystrip(text_of(text)))
    return F.when(n < 60, 0.35).when(n < 120, 0.55).when(n < 180, 0.85).otherwise(1.0)


def title_only(section: Column, text: Column) -> Column:
    n = F.char_length(pystrip(text_of(text)))
    return F.when((n < 100) & F.rlike(normalize_section(section), F.lit(MODEL_SECTION)), 0.45).when(n < 80, 0.55).otherwise(1.0)


def boilerplate(text: Column) -> Column:
    head = F.left(text_of(text), F.lit(12000))
    return F.when(F.rlike(head, F.lit(NOISE_PATTERN)) & ~F.rlike(head, F.lit(TECH_PATTERN)), 0.32).otherwise(1.0)


def term_coverage(text: Column, terms: Column, low: Column | None = None) -> Column:
    """0.78 to 1.28 by the share of distinct terms that are substrings of the text, whose lower case may be given; 1 for fewer than two terms."""
    low, distinct = F.lower(text_of(text)) if low is None else low, F.array_distinct(terms)
    share = F.size(F.filter(distinct, lambda t: F.contains(low, t))) / F.greatest(F.lit(1), F.size(distinct))
    return F.when((F.size(terms) < 2) | (low == ""), 1.0).otherwise(0.78 + 0.5 * share)


def section_match(section: Column, has_focus: Column, terms: Column, phrases: Column) -> Column:
    norm = normalize_section(section)
    touches = F.exists(phrases, lambda p: (F.char_length(p) >= 5) & (F.contains(norm, p) | F.contains(p, norm)))
    distinct = F.array_distinct(terms)
    hits = F.size(F.array_intersect(distinct, bm25_tokens(norm)))
    some = (F.size(terms) >= 2) & (hits >= 2)
    return (
        F.when(norm == "", 1.0)
        .when(has_focus & F.rlike(norm, F.lit(MODEL_SECTION)), 0.62)
        .when(touches, 1.55)
        .when(some, 1.0 + 0.35 * F.least(F.lit(1.0), hits / F.greatest(F.lit(1), F.size(distinct))))
        .otherwise(1.0)
    )


def generic_section(section: Column, phrases: Column) -> Column:
    norm = normalize_section(section)
    touches = F.exists(phrases, lambda p: (F.char_length(p) >= 5) & (F.contains(norm, p) | F.contains(p, norm)))
    penalised = (norm != "") & (F.size(phrases) > 0) & ~touches & F.rlike(norm, F.lit(GENERIC_SECTION))
    return F.when(penalised, 0.58).otherwise(1.0)


def spec_section(section: Column, terms: Column) -> Column:
    return F.when(F.rlike(text_of(section), F.lit(SPEC_SECTION)) & (F.size(terms) >= 1), 1.22).otherwise(1.0)


# ---------------------------------------------------------------- answers, language, prompts


def drop_lines(text: Column, keep) -> Column:
    return pystrip(F.array_join(F.filter(lines(text_of(text)), keep), "\n"))


def without_disclaimers(text: Column) -> Column:
    return drop_lines(text, lambda x: ~contains_any(F.lower(x), DISCLAIMERS))


def without_negative_lines(text: Column) -> Column:
    return drop_lines(text, lambda x: ~F.rlike(x, F.lit(NEGATIVE_LINE)))


def language_route(question: Column) -> Column:
    q = pystrip(text_of(question))
    tokens = F.regexp_extract_all(F.lower(q), F.lit("[a-z']+"), F.lit(0))
    mixed = F.arrays_overlap(tokens, words(HINGLISH)) & F.arrays_overlap(tokens, words(HINGLISH_TRIGGERS))
    return F.when(F.rlike(q, F.lit(r"[ऀ-ॿ]")), "Hindi").when(mixed, "Hinglish").otherwise("English")


def embedding_prompt(text: Column, role: str, style: str) -> Column:
    if style != "embeddinggemma":
        return text
    prefix = "task: search result | query: " if role == "query" else "title: none | text: "
    return F.when(pystrip(text_of(text)) == "", text).otherwise(F.concat(F.lit(prefix), text))


def run_on_bullets(text: Column) -> Column:
    """Bullets that run on behind ``;``, ``.`` or ``:`` get a line each."""
    split = F.regexp_replace(text, r"(?<=[;.:])[ \t]+•[ \t]*", "\n• ")
    return F.regexp_replace(split, r"(?m)(?<=\S)[ \t]+•[ \t]+(?=\S)", "\n• ")


def key_points_spacing(text: Column) -> Column:
    return F.regexp_replace(text, r"(?i)(?<=\S)[ \t]*\n+(?=key points:)", "\n\n")


# List marks that get a line of their own in a long answer without breaks.
LIST_BREAKS = (
    (r"(?i)\s+(adjustment to the\s+\w+\s+manipulator\s*:)", "\n\n$1"),
    (r"(?i)\s+(adjustment to automatic tube feeder\s*:)", "\n\n$1"),
    (r"(?m)(^|[:;])\s*(\d+\))\s+", "$1\n$2 "),
    (r"(?m)(^|[:;])\s*(\d{1,2}\.)\s+(?!\d)", "$1\n$2 "),
    (r"(?im)(^|[:;])\s*([a-h]\.)\s+", "$1\n  $2 "),
)


def question_apart(text: Column) -> Column:
    """A closing question of one line gets a paragraph of its own, if it starts within 260 characters of its mark and ends within 180 of the end."""
    n = F.char_length(text)

    def split(mark_from_end: Column) -> Column:
        head = F.left(text, n - mark_from_end)
        size = F.char_length(head)
        # the last ". " or "! " before the mark
        ends = [F.locate(x, F.reverse(head)) for x in (" .", " !")]
        start = F.greatest(*[F.when(e > 0, size - e).otherwise(F.lit(0)) for e in ends])
        apart = (start > 0) & (start < size) & (size - start <= 260) & (mark_from_end <= 180)
        both = F.concat(F.regexp_replace(F.left(text, start), r"\s+$", ""), F.lit("\n\n"), F.regexp_replace(F.substring(text, start + 1, n), r"^\s+", ""))
        return F.when(apart, pystrip(both)).otherwise(text)

    return F.when(F.contains(text, F.lit("\n")) | ~F.contains(text, F.lit("?")), text).otherwise(bind(F.locate("?", F.reverse(text)), split))


def lists_apart(text: Column) -> Column:
    """Items of a list inside a long line get lines of their own."""
    out = text
    for pattern, to in LIST_BREAKS:
        out = F.regexp_replace(out, pattern, to)
    long_ = ~F.contains(text, F.lit("\n")) & (F.char_length(text) >= 320)
    return F.when(long_, pystrip(F.regexp_replace(out, r"\n{3,}", "\n\n"))).otherwise(text)


def answer_for_display(text: Column, denial: tuple[str, ...] = ()) -> Column:
    """Disclaimers and rules go, dashes become bullets, a question and lists get lines of their own, single breaks become hard breaks.

    Lines equal to one of ``denial`` (lower case) go where the answer has other lines.
    """
    t = without_disclaimers(pystrip(text_of(text)))
    t = F.regexp_replace(t, r"(?m)^\s*(?:-{3,}|\*{3,}|_{3,})\s*$", "")
    t = key_points_spacing(run_on_bullets(t))
    t = F.regexp_replace(t, r"(?i)the correct answer.*?:", "")
    dash = r"^(\s*)- (\S.*)$"
    rows = F.transform(lines(t), lambda x: F.when(F.rlike(x, F.lit(dash)), F.regexp_replace(x, dash, "$1• $2")).otherwise(F.translate(x, "●", "•")))
    if denial:
        own = lambda x: F.lower(pystrip(x)).isin(*denial)
        rows = bind(rows, lambda r: F.when(F.size(F.filter(r, lambda x: pystrip(x) != "")) > 1, F.filter(r, lambda x: ~own(x))).otherwise(r))
    t = bind(bind(F.array_join(rows, "\n"), question_apart), lists_apart)
    t = F.regexp_replace(t, r"(?<!\n)\n(?!\n)", "  \n")
    return pystrip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def out_of_domain(text: Column, phrases: tuple[str, ...]) -> Column:
    """Whether a text holds one of the assistant's own stock phrases (lower case), white space aside."""
    return contains_any(F.lower(squeeze(text_of(text))), phrases)


def strip_markers(text: Column, markers) -> Column:
    alternatives = "|".join(rf"\Q{m}\E" for m in markers)
    return F.regexp_replace(text_of(text), rf"^(?:{alternatives}|\s)+", "")


def preview(text: Column, head: int = 140, tail: int = 90) -> Column:
    flat = squeeze(text_of(text))
    return F.when(F.char_length(flat) <= head + tail + 5, flat).otherwise(F.concat(F.left(flat, F.lit(head)), F.lit(" ... "), F.right(flat, F.lit(tail))))


def draft_tail(text: Column, most: int = 1400) -> Column:
    return pystrip(F.right(pystrip(text_of(text)), F.lit(most)))


def chat_title(text: Column, most: int = 800) -> Column:
    flat = pystrip(F.regexp_replace(pystrip(F.regexp_replace(text_of(text), r"\n", " ")), r"\s*\([^()]*\)$", ""))
    return F.when(flat == "", "(empty)").when(F.char_length(flat) > most, F.concat(F.left(flat, F.lit(most - 1)), F.lit("…"))).otherwise(flat)


def final_answer(server: Column, streamed: Column, tags: Column) -> Column:
    body = F.coalesce(F.nullif(pystrip(server), F.lit("")), pystrip(streamed), F.lit(""))
    return F.when((text_of(tags) == "") | F.contains(body, F.lit("<img")), body).otherwise(F.concat(body, F.lit("\n\n"), tags))


def request_time(iso: Column) -> Column:
    """ISO text, naive as UTC, as ``Mon dd, yyyy h:mm AM`` in the session's zone; else its first 19 characters."""
    at = F.try_to_timestamp(iso)
    return F.coalesce(F.date_format(at, "MMM dd, yyyy h:mm a"), F.left(iso, F.lit(19)))


def speech_sentences(text: Column) -> Column:
    """Markdown marks gone, then sentences."""
    clear = F.regexp_replace(F.regexp_replace(text_of(text), r"[*_`#>]+", ""), r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    return F.filter(F.transform(F.regexp_extract_all(clear, F.lit(r"[^.!?\n]+[.!?\n]*"), F.lit(0)), pystrip), lambda x: x != "")


def range_label(start: Column, end: Column) -> Column:
    """MM:SS-MM:SS, with hours from one hour on."""

    def one(sec: Column) -> Column:
        pad = lambda x: F.format_string("%02d", x.cast("bigint"))
        h, m, s = F.floor(sec / 3600), F.floor(sec / 60) % 60, sec % 60
        return F.when(sec >= 3600, F.concat_ws(":", pad(h), pad(m), pad(s))).otherwise(F.concat_ws(":", pad(m), pad(s)))

    return F.concat(one(start), F.lit("-"), one(end))


def parse_clock(c: Column) -> Column:
    """Seconds of MM:SS or HH:MM:SS; null unless minutes and seconds are below 60."""
    parts = F.transform(F.split(pystrip(c), ":"), lambda x: x.try_cast("bigint"))
    n, low = F.size(parts), F.element_at(parts, -1)
    mid = F.when(n >= 2, F.get(parts, n - 2))
    top = F.when(n == 3, F.get(parts, F.lit(0))).otherwise(F.lit(0))
    fine = n.isin(2, 3) & low.between(0, 59) & (mid >= 0) & ((n == 2) | (mid < 60)) & (top >= 0)
    return F.when(fine, top * 3600 + mid * 60 + low)


def token_redundancy(part: Column, context: Column) -> Column:
    """struct(redundant, jaccard, coverage) of token sets of two characters or more."""
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(text_of(c)), F.lit("[a-z0-9]{2,}"), F.lit(0)))
    a, b = tokens(part), tokens(context)
    common = F.size(F.array_intersect(a, b))
    empty = (F.size(a) == 0) | (F.size(b) == 0)
    jaccard = F.when(empty, 0.0).otherwise(common / F.size(F.array_union(a, b)))
    coverage = F.when(empty, 0.0).otherwise(common / F.greatest(F.lit(1), F.size(a)))
    return F.struct(((coverage >= 0.72) | (jaccard >= 0.75)).alias("redundant"), jaccard.alias("jaccard"), coverage.alias("coverage"))


def word_jaccard(a: Column, b: Column) -> Column:
    words_ = lambda c: F.array_distinct(F.filter(F.split(F.lower(text_of(c)), r"\s+"), lambda x: x != ""))
    x, y = words_(a), words_(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def judge_reply(reply: Column) -> Column:
    """struct(score 1 to 5, explanation, error) of a judge's JSON, fenced or inside other text."""
    bare = F.regexp_replace(pystrip(text_of(reply)), r"^```(?:json)?\s*|\s*```$", "")
    schema = "score string, explanation string"
    parsed = F.from_json(F.regexp_extract(bare, r"(?s)\{.*\}", 0), schema)
    score = parsed["score"].try_cast("double").cast("int")
    return F.struct(F.when(score.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(5), score))).alias("score"), F.coalesce(parsed["explanation"], F.lit("")).alias("explanation"), F.when(score.isNull(), F.lit("unparseable reply")).alias("error"))


def gate_reply(reply: Column) -> Column:
    """Relevant unless the reply says IRRELEVANT; what can't be read is relevant."""
    return ~F.contains(F.upper(text_of(reply)), F.lit("IRRELEVANT"))


# The shapes of citations. Emphasis marks may stand around each part.
CITED_PAGE = r"(?i)([^\[\],;\n]+\.pdf)\s*\*{0,2}\s*[,;]\s*\*{0,2}\s*page\s+(\d+)\b"
CITED_TIME = r"(?i)([^\[\],;\n]+\.(?:mp4|mov|mkv|avi|webm))\s*\*{0,2}\s*[,;]\s*\*{0,2}\s*(?:(?:timestamp|time|at)\s*\*{0,2}\s+)?\*{0,2}\s*(\d{1,2}:\d{2}(?::\d{2})?\s*[–—-]\s*\d{1,2}:\d{2}(?::\d{2})?)"
CITED_PASSAGE = r"(?i)\[\s*\*{0,2}Passage\s+(\d+)\s*\*{0,2}\s*(?:,|\]\s*,?)\s*\*{0,2}\s*page\s+(\d+)\b"
BARE_PAGE = r"(?i)(?<![A-Za-z0-9_])\[?\s*(?:page|pg|p\.)\s*[:#-]?\s*(\d{1,4})\s*\]?(?![A-Za-z0-9_])"
BARE_TIME = r"(\d{1,2}:\d{2}(?::\d{2})?\s*[–—-]\s*\d{1,2}:\d{2}(?::\d{2})?)"
LEADING_PHRASE = r"(?i)^(?:according\s+to|from|in|per|see|refer\s+to)\s+"


def cited_name(raw: Column, known: Column | None = None) -> Column:
    """A document's name out of what stands before a page or time: without marks and a leading phrase.

    ``known`` (an array of names) tells where prose ends and the name begins: the longest name that ends it; null if none does.
    """
    bare = pystrip(F.regexp_replace(raw, r"^[\s*(]+|[\s*]+$", ""))
    name = pystrip(F.regexp_replace(bare, LEADING_PHRASE, ""))
    if known is None:
        return name
    ends = F.filter(known, lambda k: F.endswith(F.lower(name), F.lower(k)) & F.rlike(F.left(name, F.char_length(name) - F.char_length(k)), F.lit(r"(^|[\s*(])$")))
    return F.array_max(F.transform(ends, lambda k: F.struct(F.char_length(k).alias("n"), k.alias("k"))))["k"]


def citations(text: Column, known: Column | None = None, sole: Column | None = None) -> Column:
    """Distinct citations as structs (doc, page, passage, start_sec, time), shape by shape.

    Documents with a page, videos with a time range, and numbered passages with a page, inside or behind
    their bracket. Where ``sole`` names the only document of an answer, passages and bare pages or times
    are that document's.
    """
    t = text_of(text)
    none = F.lit(None)
    doc_of = (lambda: F.lit(None).cast("string")) if sole is None else (lambda: sole)

    def cited(doc: Column, page=none, passage=none, time=none) -> Column:
        label = F.regexp_replace(time.cast("string"), r"\s*[–—-]\s*", "-")
        return F.struct(doc.alias("doc"), page.try_cast("bigint").alias("page"), passage.try_cast("bigint").alias("passage"), parse_clock(F.substring_index(label, "-", 1)).alias("start_sec"), label.alias("time"))

    def every(pattern: str, make) -> Column:
        found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        return F.transform(found, lambda x: make(lambda i: F.regexp_extract(x, pattern, i)))

    shapes = [
        every(CITED_PAGE, lambda part: cited(cited_name(part(1), known), page=part(2))),
        every(CITED_TIME, lambda part: cited(cited_name(part(1), known), time=part(2))),
        every(CITED_PASSAGE, lambda part: cited(doc_of(), page=part(2), passage=part(1))),
    ]
    if sole is not None:
        rest = t
        for pattern in (CITED_PAGE, CITED_TIME, CITED_PASSAGE):
            rest = F.regexp_replace(rest, pattern, " ")
        for pattern, make in ((BARE_PAGE, lambda x: cited(sole, page=x)), (BARE_TIME, lambda x: cited(sole, time=x))):
            shapes.append(F.transform(F.regexp_extract_all(rest, F.lit(pattern), F.lit(1)), make))
    found = F.array_distinct(F.concat(*shapes))
    return found if known is None else F.filter(found, lambda c: c["doc"].isNotNull() | c["passage"].isNotNull())


def delta_slices(text: Column, width: int = 56) -> Column:
    n = F.char_length(text_of(text))
    starts = F.when(n > 0, F.sequence(F.lit(1), n, F.lit(width))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(text_of(text), i, F.lit(width)))


def config_value(raw: Column, kind: str, default) -> Column:
    """A config entry as int, double or boolean, or its default where it is missing or can't be read."""
    if kind == "boolean":
        low = F.lower(pystrip(raw))
        return F.when(raw.isNull(), F.lit(default)).otherwise(low.isin("1", "true", "yes", "y", "on"))
    return F.coalesce(raw.try_cast("double").cast(kind) if kind == "int" else raw.try_cast(kind), F.lit(default))


def assemble_prompt(question: Column, context: Column, language: Column, part: Column, parts: Column, rules: str) -> Column:
    """A fixed block of rules first, so that it can be cached, then notes on part and language, the question and the context."""
    part_note = F.when(parts > 1, F.concat(F.lit("This is part "), part.cast("string"), F.lit(" of "), parts.cast("string"), F.lit("; don't repeat earlier parts.")))
    language_note = F.when(language != "English", F.concat(F.lit("Answer in "), language, F.lit(".")))
    return F.concat_ws("\n\n", F.lit(rules), part_note, language_note, F.concat(F.lit("Question: "), question), F.concat(F.lit("Context:\n"), context))


def inline_bullets(line: Column) -> Column:
    """A line with two bullets or more inside as one line each; others as they are."""
    parts = F.filter(F.transform(F.split(line, "•"), pystrip), lambda x: x != "")
    bullets = F.regexp_count(line, F.lit("•"))
    head = F.when(F.startswith(pystrip(line), F.lit("•")), F.array().cast("array<string>")).otherwise(F.slice(parts, 1, 1))
    rest = F.when(F.startswith(pystrip(line), F.lit("•")), parts).otherwise(F.slice(parts, 2, 10_000))
    return F.when(bullets < 2, line).otherwise(F.array_join(F.concat(head, F.transform(rest, lambda x: F.concat(F.lit("• "), x))), "\n"))


def file_id(path: Column) -> Column:
    """URL-safe base64 of a path, without padding and without the line breaks that Spark puts after 76 characters."""
    return F.regexp_replace(F.translate(F.base64(path.cast("binary")), "+/\r\n", "-_"), "=+$", "")


def path_of(file_id_: Column) -> Column:
    """The path of a file id; null if it is none."""
    plain = F.translate(file_id_, "-_", "+/")
    padded = F.concat(plain, F.repeat(F.lit("="), (4 - F.char_length(plain) % 4) % 4))
    return F.try_to_binary(padded, F.lit("base64")).cast("string")


def inside(path: Column, folder: str) -> Column:
    """Whether a path lies in a folder, without steps upwards."""
    return F.startswith(path, F.lit(folder.rstrip("/") + "/")) & ~F.rlike(path, F.lit(r"(^|/)\.\.(/|$)"))
