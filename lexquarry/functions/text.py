"""Column expressions on text. Each takes columns (or names) and returns a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Col = Column | str

# The blocks of CJK characters that are indexed as bigrams, and the archives of old identifiers.
CJK = "\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{3040}-\\x{30FF}"
LEGACY_ARCHIVES = (
    "acc-phys", "adap-org", "alg-geom", "ao-sci", "astro-ph", "atom-ph", "bayes-an", "chao-dyn", "chem-ph", "cmp-lg",
    "comp-gas", "cond-mat", "cs", "dg-ga", "funct-an", "gr-qc", "hep-ex", "hep-lat", "hep-ph", "hep-th", "math",
    "math-ph", "mtrl-th", "nlin", "nucl-ex", "nucl-th", "patt-sol", "physics", "plasm-ph", "q-alg", "q-bio",
    "quant-ph", "solv-int", "supr-con",
)
# arXiv's identifier scheme: since April 2007 YYMM.number of four or five digits; before, archive, an optional subject class
# of two letters, and seven digits. A version may follow.
_SERIAL = r"\d{4}\.\d{4,5}"
_OLD_SERIAL = r"(?i:" + "|".join(LEGACY_ARCHIVES) + r")(?:\.[a-zA-Z]{2})?/\d{7}"
_ARXIV = f"({_SERIAL}|{_OLD_SERIAL})"
# What stands before an identifier to say that it is one, whatever dots, colons, slashes and blanks follow,
# and the punctuation that ends a sentence or a bracket rather than a DOI.
ARXIV_LABELS = ("abs", "arxiv", "e-print", "pdf")
AFTER_DOI = ".,;)]}"
# Fixed value: the public syntax of wikilinks.
WIKILINK = r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]"
MARKDOWN_LINK = r"\]\((?:<([^>\n]+)>|([^)\n]+))\)"
# CommonMark's inline image: a destination in angle brackets or without white space; what follows it, a title, is not needed
MARKDOWN_IMAGE = r"!\[[^\]]*\]\(\s*(?:<([^<>\n]*)>|([^\s()<>]+))[^)\n]*\)"
IMAGE_TAG = r"(?is)<(?:img|embed)\s[^>]*>"
# HTML's three ways to write an attribute's value
SOURCE_ATTRIBUTE = r"""(?is)\ssrc\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def _c(c: Col) -> Column:
    return F.col(c) if isinstance(c, str) else c


def found(c: Col, pattern: str, group: int = 1) -> Column:
    """regexp_extract that is null, not empty, without a match."""
    x = _c(c)
    return F.when(x.rlike(pattern), F.regexp_extract(x, pattern, group))


def _once(value: Column, then) -> Column:
    """then(value), with the value computed once however often `then` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def squeezed(c: Col) -> Column:
    """Runs of white space become one blank, none at the ends."""
    return F.trim(F.regexp_replace(_c(c), r"\s+", " "))


def link_key(c: Col) -> Column:
    """How link texts are compared: trimmed, lower case, underscores as blanks."""
    return F.lower(F.replace(F.trim(_c(c)), F.lit("_"), F.lit(" ")))


def slug(c: Col, most: int | None = 80) -> Column:
    """Lower case words joined by hyphens; over `most` characters cut at the last hyphen if that keeps half."""
    x = F.lower(F.replace(_c(c), F.lit("_"), F.lit("-")))
    x = F.regexp_replace(F.regexp_replace(x, r"(?U)\s+", "-"), r"(?U)[^\w-]", "")
    x = F.trim(F.regexp_replace(x, "-+", "-"), F.lit("-"))
    if not most:
        return x
    cut = F.substring(x, 1, most)
    head = F.regexp_extract(cut, "^(.*)-", 1)
    short = F.when(F.length(head) >= most // 2, head).otherwise(cut)
    return F.when(F.length(x) <= most, x).otherwise(F.trim(short, F.lit("-")))


def index_text(c: Col) -> Column:
    """CJK runs as overlapping bigrams (a single character stays), set apart by blanks; other text as it is."""
    x = _c(c)
    apart = F.regexp_replace(x, rf"([{CJK}]+)", " $1 ")
    # a character inside a run ends one pair and begins the next
    pairs = F.regexp_replace(apart, rf"(?<=[{CJK}])([{CJK}])(?=[{CJK}])", "$1 $1")
    # most texts hold none and need no second copy
    return F.when(x.rlike(f"[{CJK}]"), pairs).otherwise(x)


def terms(c: Col) -> Column:
    """Lower case maximal runs of letters and digits; CJK runs as bigrams."""
    return F.regexp_extract_all(F.lower(index_text(c)), F.lit(r"([\p{L}\p{N}]+)"), 1)


def wikilinks(c: Col) -> Column:
    return F.regexp_extract_all(_c(c), F.lit(WIKILINK), 1)


def markdown_links(c: Col) -> Column:
    """Targets in parentheses, with or without angle brackets."""
    one, two = (F.regexp_extract_all(_c(c), F.lit(MARKDOWN_LINK), i) for i in (1, 2))
    return F.zip_with(one, two, lambda a, b: F.when(a != "", a).otherwise(b))


def image_targets(c: Col) -> Column:
    """Targets of Markdown images, then of HTML images, in the order they stand."""
    one, two = (F.regexp_extract_all(_c(c), F.lit(MARKDOWN_IMAGE), i) for i in (1, 2))
    tags = F.filter(F.regexp_extract_all(_c(c), F.lit(IMAGE_TAG), 0), lambda x: x.rlike(SOURCE_ATTRIBUTE))
    sources = F.transform(tags, lambda x: F.concat(*(F.regexp_extract(x, SOURCE_ATTRIBUTE, i) for i in (1, 2, 3))))
    return F.concat(F.zip_with(one, two, lambda a, b: F.when(a != "", a).otherwise(b)), sources)


def image_kind(c: Col, folder: str = "images") -> Column:
    """external, absolute, backslash, escaping, bare, elsewhere, nested or portable."""
    x = _c(c)
    parts = F.split(x, "/")
    return (
        F.when(x.rlike(r"^(http://|https://|data:|//)"), "external").when(x.rlike(r"^([A-Za-z]:[\\/]|/|\\)"), "absolute").when(x.contains("\\"), "backslash")
        .when(F.array_contains(parts, ".."), "escaping").when(F.size(parts) == 1, "bare").when(parts[0] != folder, "elsewhere").when(F.size(parts) > 2, "nested").otherwise("portable")
    )


def safe_name(c: Col) -> Column:
    """The last part of a path with unsafe characters as underscores; `image` if nothing is left."""
    base = F.regexp_extract(F.replace(_c(c), F.lit("\\"), F.lit("/")), r"([^/]*)$", 1)
    name = F.trim(F.regexp_replace(base, r"(?U)[^\w.\-]+", "_"), F.lit("._"))
    return F.when(name == "", "image").otherwise(name)


def namespaced(prefix: Col, c: Col, most: int = 110) -> Column:
    """`<prefix>-<name>`, unchanged if the name has the prefix; too long a stem loses its beginning."""
    name, p = safe_name(c), safe_name(prefix)
    ext = F.regexp_extract(name, r"(?<=.)(\.[^.]*)$", 1)
    stem = F.substr(name, F.lit(1), F.length(name) - F.length(ext))
    room = F.lit(most - 1) - F.length(p) - F.length(ext)
    tail = F.when(F.length(stem) > room, F.substr(stem, F.length(stem) - room + 1)).otherwise(stem)
    return F.when(F.startswith(F.lower(name), F.concat(F.lower(p), F.lit("-"))), F.substring(name, 1, most)).when(room < 1, F.concat(F.substr(p, F.lit(1), F.lit(most) - F.length(ext)), ext)).otherwise(F.concat(p, F.lit("-"), tail, ext))


def _canonical(raw: Column) -> Column:
    """An identifier with its archive in small and its subject class in capital letters."""
    archive, serial = F.split_part(raw, F.lit("/"), F.lit(1)), F.split_part(raw, F.lit("/"), F.lit(2))
    base, subject = F.split_part(archive, F.lit("."), F.lit(1)), F.split_part(archive, F.lit("."), F.lit(2))
    old = F.concat(F.lower(base), F.when(subject != "", F.concat(F.lit("."), F.upper(subject))).otherwise(""), F.lit("/"), serial)
    return F.when(raw.contains("/"), old).otherwise(raw)


def _identifiers(x: Column) -> Column:
    """What has an identifier's form in a text, as structs of `id`, whether it is `labelled`, and whether it is `bare`: no
    letter or digit touches it but those of a version. The forms are found first and judged by what stands around them."""

    def judged(parts: Column) -> Column:
        def one(found: Column, k: Column) -> Column:
            before, after = F.get(parts["around"], k), F.get(parts["around"], k + 1)
            said = F.rtrim(F.lower(F.regexp_replace(F.right(before, F.lit(40)), r"[\s.:/]+$", "")))
            labelled = F.lit(False)
            for label in ARXIV_LABELS:
                labelled |= F.endswith(said, F.lit(label))
            # two forms that touch are neither's end nor beginning
            apart = ~before.rlike(r"\w$") & ((k == 0) | (before != "")) & ((after != "") | (k == F.size(parts["found"]) - 1))
            return F.struct(found.alias("id"), labelled.alias("labelled"), (apart & after.rlike(r"^(?:v[0-9]+)?(?:\W|$)")).alias("bare"))

        return F.transform(parts["found"], one)

    whole = _once(F.struct(F.regexp_extract_all(x, F.lit(_ARXIV), 1).alias("found"), F.split(x, _ARXIV, -1).alias("around")), judged)
    return F.when(x.rlike(r"[0-9]{4}\.[0-9]{4}|/[0-9]{7}"), whole)


def arxiv_id(c: Col) -> Column:
    """The first identifier, canonical and without version: labelled ones first, then bare ones; null if none."""
    first = lambda found, kind: F.get(F.filter(found, lambda x: x[kind]), F.lit(0))["id"]
    return _once(_once(_c(c), _identifiers), lambda found: _canonical(F.coalesce(first(found, "labelled"), first(found, "bare"))))


def arxiv_ids(c: Col) -> Column:
    """Every bare identifier in a text, as written, without versions."""
    found = _once(_c(c), _identifiers)
    ids = F.transform(F.filter(found, lambda x: x["bare"]), lambda x: x["id"])
    return F.array_distinct(F.coalesce(ids, F.when(_c(c).isNotNull(), F.array().cast("array<string>"))))


def is_legacy_arxiv(c: Col) -> Column:
    return _c(c).contains("/")


def abs_url(c: Col) -> Column:
    return F.concat(F.lit("https://arxiv.org/abs/"), _c(c))


def doi(c: Col) -> Column:
    """The first DOI, lower case, without trailing punctuation. A text is cut at white space, quotation marks, angle brackets
    and commas; of a piece's parts between slashes one must end in a prefix, the directory indicator 10 and a registrant's
    number, and what follows it is the suffix."""

    def read(piece: Column) -> Column:
        def at(parts: Column) -> Column:
            place = F.array_position(F.transform(parts, lambda p: p.rlike(r"(?U)(?<!\w)10\.[0-9]{4,9}$")), F.lit(True)).cast("int")
            suffix = F.array_join(F.slice(parts, place + 1, F.size(parts)), "/")
            return F.when((place > 0) & (suffix != ""), F.concat_ws("/", F.regexp_extract(F.get(parts, place - 1), r"(10\.[0-9]+)$", 1), suffix))

        return _once(F.split(piece, "/"), at)

    pieces = F.filter(F.split(_c(c), r"(?U)[\s\"'<>,]+"), lambda p: p.contains("10."))
    first = F.get(F.filter(F.transform(pieces, read), lambda x: x.isNotNull()), F.lit(0))
    return F.when(_c(c).contains("10."), F.lower(F.rtrim(first, F.lit(AFTER_DOI))))


def arxiv_in_doi(c: Col) -> Column:
    x = _c(c)
    return F.coalesce(arxiv_id(found(x, r"(?i)10\.48550/arxiv\.(.+)$")), F.when(F.lower(x).contains("arxiv"), arxiv_id(x)))


def identity(c: Col) -> Column:
    """struct(arxiv_id, doi, source): what a text says about its paper, and how it was learnt."""

    def parts(x: Column) -> Column:
        return _once(F.struct(doi(x).alias("doi"), arxiv_id(x).alias("arxiv")), lambda s: _once(F.struct(s["doi"].alias("doi"), s["arxiv"].alias("arxiv"), arxiv_in_doi(s["doi"]).alias("inside")), told))

    def told(s: Column) -> Column:
        source = F.when(s["arxiv"].isNotNull(), "text").when(s["inside"].isNotNull(), "doi-text").otherwise("")
        return F.struct(F.coalesce(s["arxiv"], s["inside"]).alias("arxiv_id"), s["doi"].alias("doi"), source.alias("source"))

    return _once(_c(c), parts)


def titles_match(a: Col, b: Col, share: float = 0.6) -> Column:
    """At least `share` of the shorter title's distinct words are in the other; a missing title contradicts nothing."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(_c(c), F.lit(""))), F.lit("([a-z0-9]+)"), 1))
    x, y = words(a), words(b)
    least = F.least(F.size(x), F.size(y))
    return (least == 0) | (F.size(F.array_intersect(x, y)) >= share * least)


def source_type(c: Col) -> Column:
    """url, doi, arxiv or file."""
    x = _c(c)
    return F.when(x.rlike(r"(?i)^https?://"), "url").when(x.rlike(r"(?i)^(doi:)?\s*10\.[0-9]{4,9}/"), "doi").when(arxiv_id(x).isNotNull(), "arxiv").otherwise("file")


def target_kind(c: Col, known_files: Column | None = None) -> Column:
    """arxiv, doi, file (if in known_files, an array) or url."""
    i = identity(c)
    exists = F.lit(False) if known_files is None else F.array_contains(known_files, _c(c))
    return F.when(i["arxiv_id"].isNotNull(), "arxiv").when(i["doi"].isNotNull(), "doi").when(exists, "file").otherwise("url")


def claim_id(node: Col, text: Col) -> Column:
    return F.concat(F.lit("claim:"), F.substring(F.sha1(F.concat_ws("|", _c(node), _c(text))), 1, 12))


def snippet(c: Col, most: int = 300) -> Column:
    return F.substring(squeezed(c), 1, most)


def ellipsized(c: Col, most: int = 500) -> Column:
    """Cut at the last white space before `most`, with an ellipsis."""
    x = _c(c)
    cut = F.substring(x, 1, most)
    head = F.regexp_extract(cut, r"^(.*\S)\s", 1)
    return F.when(F.length(x) <= most, x).otherwise(F.concat(F.rtrim(F.when(head == "", cut).otherwise(head)), F.lit("…")))


def display_name(c: Col) -> Column:
    return F.initcap(F.replace(_c(c), F.lit("-"), F.lit(" ")))


def authors(c: Col) -> Column:
    """Names split at semicolons, `and` and commas."""
    return F.filter(F.transform(F.split(_c(c), r";|\s+and\s+|,"), lambda a: F.trim(a)), lambda a: a != "")


def frontmatter(c: Col) -> Column:
    """The block between the first two `---` lines of a text, line ends made uniform; null if there is none."""
    x = F.regexp_replace(_c(c), r"\r\n?", "\n")
    return found(x, r"(?s)^---\n(.*?)\n---")


def body(c: Col) -> Column:
    """What follows the frontmatter, or the whole text."""
    return F.regexp_replace(F.regexp_replace(_c(c), r"\r\n?", "\n"), r"(?s)\A---\n.*?\n---[^\n]*\n?", "")


def scalar_field(block: Col, name: str) -> Column:
    """A one-line field of a frontmatter block without its quotes; null if missing or empty."""
    raw = F.trim(found(block, rf"(?m)^{name}:[ \t]*(.*)$"))
    return F.nullif(F.regexp_replace(raw, r"""^(["'])(.*)\1$""", "$2"), F.lit(""))


def list_field(block: Col, name: str) -> Column:
    """An inline `[a, "b,c"]` or block `  - a` list of a frontmatter block; null if missing."""
    inline = found(block, rf"(?m)^{name}:[ \t]*\[(.*)\][ \t]*$")
    items = F.transform(F.regexp_extract_all(inline, F.lit(r"""((?:"[^"]*"|'[^']*'|[^,"'])+)"""), 1), lambda v: F.trim(v))
    lines = found(block, rf"(?m)^{name}:[ \t]*((?:\n  - .*)+)")
    listed = F.transform(F.regexp_extract_all(lines, F.lit(r"(?m)^  - (.*)$"), 1), lambda v: F.trim(v))
    clean = lambda a: F.filter(F.transform(a, lambda v: F.regexp_replace(v, r"""^(["'])(.*)\1$""", "$2")), lambda v: v != "")
    return F.coalesce(clean(items), clean(listed))


def _outside(c: Column, mark: str, blank: str) -> Column:
    """A text without what stands between the first and second, third and fourth, ... mark; a last mark without a partner
    takes nothing away."""
    parts = F.split(c, mark, -1)
    return F.array_join(F.filter(parts, lambda x, i: (i % 2 == 0) | (i == F.size(parts) - 1)), blank)


def without_fences(c: Col) -> Column:
    """A text without the blocks of fenced code, each of which leaves one blank."""
    return F.substr(_outside(F.concat(F.lit("\n"), _c(c)), r"\n```[^\n]*", "\n "), F.lit(2))


def prose(c: Col) -> Column:
    """Text without fenced code and math: what stands between pairs of `$$`, then of `$` within a line, is a blank."""
    lines = F.split(_outside(without_fences(c), r"\$\$", " "), "\n", -1)
    return F.array_join(F.transform(lines, lambda line: _outside(line, r"\$", " ")), "\n")


def word_count(c: Col) -> Column:
    return F.size(F.filter(F.split(_c(c), r"\s+"), lambda w: w != ""))


# What an article without a summary is called, the length from which a paragraph is one, how much of it is
# kept, and what templates leave in the text that is embedded.
NO_SUMMARY, LEAST_SUMMARY, LONGEST_SUMMARY = "Compiled wiki article.", 40, 260
BOILERPLATE = (
    "No explicit definition extracted from literature perspective.", "No explicit mathematical representation extracted from literature perspective.",
    "[STUB: Awaiting synthesis]",
)


def plain_summary(c: Col) -> Column:
    """A paragraph with links as their texts and without marks of emphasis and code, squeezed and cut."""
    links = F.regexp_replace(F.regexp_replace(_c(c), r"\[([^\]]+)\]\([^)]+\)", "$1"), r"\[\[(?:[^|\]]+\|)?([^\]]+)\]\]", "$1")
    return F.rtrim(F.substring(squeezed(F.translate(links, "*_`", "")), 1, LONGEST_SUMMARY))


def summary(c: Col) -> Column:
    """A body's line `**Summary**: ...`, else its first paragraph of 40 characters or more outside of code, with headings,
    tables and lists between paragraphs, else a fixed text. One pass over the lines."""
    said = found(c, r"(?m)^\*\*Summary\*\*:\s*(.+)$")
    state = lambda done, now, code: F.struct(done.alias("done"), now.alias("now"), code.alias("code"))

    def closed(a: Column) -> Column:
        return _once(plain_summary(a["now"]), lambda x: F.when(F.length(x) >= LEAST_SUMMARY, x))

    def step(a: Column, raw: Column) -> Column:
        def read(line: Column) -> Column:
            apart = (line == "") | (line == "---") | line.rlike(r"^(?:#|\||- |[0-9]+\.\s)")
            more = F.when(a["now"] == "", line).otherwise(F.concat(a["now"], F.lit(" "), line))
            return F.when(F.startswith(line, F.lit("```")), state(a["done"], a["now"], ~a["code"])).when(a["code"], a).when(apart, state(closed(a), F.lit(""), a["code"])).otherwise(state(a["done"], more, a["code"]))

        return F.when(a["done"].isNotNull(), a).otherwise(_once(F.regexp_replace(raw, r"^\s+|\s+$", ""), read))

    start = state(F.lit(None).cast("string"), F.lit(""), F.lit(False))
    first = F.aggregate(F.split(_c(c), r"\r\n|[\r\n]", -1), start, step, lambda a: F.coalesce(a["done"], closed(a)))
    return F.coalesce(F.when(said.isNotNull(), plain_summary(said)), first, F.lit(NO_SUMMARY))


def embedding_text(c: Col) -> Column:
    """What of an article is embedded: its body with links as their texts, without heading marks and boilerplate, and its
    tags and aliases in a sentence at the end."""
    block, x = frontmatter(c), body(c)
    x = F.regexp_replace(F.regexp_replace(x, r"\[\[([^\]\n]*)\]\]", "$1"), r"\[([^\[\]\n]*)\]\([^()\n]*\)", "$1")
    x = F.regexp_replace(x, r"#+\s*", "")
    for phrase in BOILERPLATE:
        x = F.replace(x, F.lit(phrase), F.lit(""))
    listed = lambda name: F.coalesce(list_field(block, name), F.array_compact(F.array(F.nullif(scalar_field(block, name), F.lit("[]")))))

    def context(lists: Column) -> Column:
        one = lambda k, before: F.when(F.size(lists[k]) > 0, F.concat(F.lit(before), F.array_join(lists[k], ", "), F.lit(".")))
        said = F.concat_ws(" ", one("tags", "Tags include "), one("aliases", "Known aliases: "))
        return F.when(said != "", F.concat(F.lit("\n\n[Metadata Context: "), said, F.lit("]"))).otherwise("")

    return F.concat(F.regexp_replace(x, r"^\s+|\s+\z", ""), _once(F.struct(listed("tags").alias("tags"), listed("aliases").alias("aliases")), context))


def html_text(c: Col) -> Column:
    """HTML without scripts, styles and tags."""
    return F.regexp_replace(F.regexp_replace(_c(c), r"(?is)<(script|style)\b.*?</\1>", " "), "(?s)<[^>]+>", " ")


def html_title(c: Col) -> Column:
    """The title with the basic entities decoded and a leading [id] taken off."""
    x = squeezed(found(c, r"(?is)<title[^>]*>(.*?)</title>"))
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(char))
    return F.regexp_replace(x, r"^\[[^\]]*\]\s*", "")


def tex_formulas(page: Col) -> Column:
    """TeX annotations of a page's formulas; without any, their alternative texts."""
    a = F.regexp_extract_all(_c(page), F.lit(r'(?is)<annotation[^>]*encoding="application/x-tex"[^>]*>(.*?)</annotation>'), 1)
    return F.when(F.size(a) > 0, a).otherwise(F.regexp_extract_all(_c(page), F.lit(r'(?is)\balttext="([^"]*)"'), 1))


def glob_pattern(glob: str) -> str:
    """A path glob as an anchored regular expression; `*` also crosses slashes."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        close = glob.find("]", i + 1) if c == "[" else -1
        if close > 0:
            inside = glob[i + 1 : close]
            out += "[" + ("^" + inside[1:] if inside[:1] in "!^" else inside).replace("\\", "\\\\") + "]"
            i = close
        else:
            out += {"*": ".*", "?": "."}.get(c) or ("\\" + c if not c.isalnum() and ord(c) < 128 else c)
        i += 1
    return f"(?s)^{out}$"


def collection_of(path: Col) -> Column:
    """raw, drafts, the directory below wiki, or other."""
    p = F.split(_c(path), "/")
    return F.when(p[0].isin("raw", "drafts"), p[0]).when((p[0] == "wiki") & (F.size(p) > 2), F.get(p, F.lit(1))).otherwise("other")


def page_number(c: Col) -> Column:
    """The number in a page's file name; 999999 if none."""
    return F.coalesce(found(c, r"(?i)page[-_ ]*([0-9]+)"), found(c, r"([0-9]+)(?=\.[^.]*$|$)"), F.lit("999999")).cast("int")


def redacted(c: Col, names: tuple[str, ...] = ("api_key", "apikey", "token", "secret", "password")) -> Column:
    """Values of `name: value` lines whose name ends in a secret's name are hidden."""
    return F.regexp_replace(_c(c), rf"(?im)^(\s*[\w.]*(?:{'|'.join(names)})\s*[:=]\s*)\S.*$", "$1***")
