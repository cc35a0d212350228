"""Column functions on text and paths. All are Spark expressions; patterns use explicit ASCII classes where the result
must not depend on the regex engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions import fixed_values as V

SPACES = " \t\n\x0b\f\r"


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(SPACES))


def any_contains(x: Column, markers) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(x, F.lit(m))
    return out


def first_marker(x: Column, table, default) -> Column:
    """The value of the first (markers, value) whose marker is contained in x."""
    out = None
    for value, markers in table:
        cond = any_contains(x, markers)
        out = F.when(cond, F.lit(value)) if out is None else out.when(cond, F.lit(value))
    return out.otherwise(F.lit(default))


def tokens(x: Column) -> Column:
    """Distinct tokens of at least three characters, without stop words and numbers."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(V.TOKEN), F.lit(0)))
    return F.filter(found, lambda t: ~t.isin(*V.STOPWORDS) & ~t.rlike("^[0-9]+$"))


def token_list(x: Column) -> Column:
    """Distinct tokens in order of first occurrence."""
    return F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(V.TOKEN), F.lit(0)))


def identifier_words(x: Column) -> Column:
    """Distinct words of an identifier-like ASCII text: runs of other characters and underscores separate."""
    flat = F.btrim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))
    return F.filter(F.array_distinct(F.split(flat, " ")), lambda t: t != "")


def sentences(x: Column) -> Column:
    """Sentences end at white space after . ! or ?, and at newlines; blank ones are dropped."""
    cut = F.split(x, r"(?<=[.!?])[ \t\n\x0B\f\r]+|\n+")
    return F.filter(F.transform(cut, strip), lambda s: s != "")


def list_items(x: Column, least: int = 25) -> Column:
    found = F.transform(F.regexp_extract_all(x, F.lit(V.LIST_ITEM), F.lit(1)), strip)
    return F.filter(found, lambda s: F.length(s) >= least)


def heading(x: Column) -> Column:
    """Lower-cased, without leading section number, white space collapsed."""
    return F.regexp_replace(F.regexp_replace(strip(F.lower(x)), r"^\d+(?:\.\d+)*\s+", ""), r"\s+", " ")


def heading_boost(x: Column) -> Column:
    return first_marker(heading(x), [(v, (m,)) for m, v in V.HEADING_BOOSTS], 0)


def section_kind(x: Column) -> Column:
    return first_marker(heading(x), V.SECTION_KINDS, "other")


def count_markers(x: Column, markers) -> Column:
    out = F.lit(0)
    for m in markers:
        out = out + F.contains(x, F.lit(m)).cast("int")
    return out


def sentence_score(x: Column) -> Column:
    """3 for each contribution marker, 1 for each technical marker, and up to 3 for length."""
    low = F.lower(x)
    length = F.least(F.floor(F.size(tokens(x)) / 6), F.lit(3)).cast("int")
    return 3 * count_markers(low, V.CONTRIBUTION_MARKERS) + count_markers(low, V.TECHNICAL_MARKERS) + length


def title_of(x: Column) -> Column:
    """A title from a sentence: no leading phrase, no final periods, eight words, 120 characters."""
    bare = F.rtrim(F.regexp_replace(strip(x), V.LEADING_PHRASE, ""), F.lit("."))
    words = F.filter(F.split(bare, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    return F.left(F.array_join(F.slice(words, 1, 8), " "), F.lit(120))


def references(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(x, F.lit(V.REFERENCE), F.lit(0)))


def complexity(x: Column) -> Column:
    """2, and 1 more for 12 tokens, for a reference, and for a word of implementation detail; at most 5."""
    detail = any_contains(F.lower(x), ("kernel", "optimizer", "training", "loss"))
    points = (F.size(tokens(x)) >= 12).cast("int") + (F.size(references(x)) > 0).cast("int") + detail.cast("int")
    return F.least(F.lit(5), 2 + points)


def from_marker(x: Column, markers, limit: int) -> Column:
    """From the first marker of the list that occurs, to the end, cut to `limit` characters; null if none occurs."""
    low, out = F.lower(x), None
    for m in markers:
        at = F.locate(m, low)
        value = F.substring(x, at, F.lit(limit))
        out = F.when(at > 0, value) if out is None else out.when(at > 0, value)
    return strip(out)


def steps(title: Column, hints: Column) -> Column:
    """Implementation steps: title and hints cut at punctuation and conjunctions, of 18 characters or more, first five."""
    parts = F.flatten(F.transform(F.concat(F.array(title), hints), lambda s: F.split(s, V.STEP_SPLIT)))
    return F.slice(F.array_distinct(F.filter(F.transform(parts, strip), lambda s: F.length(s) >= 18)), 1, 5)


def compact(x: Column) -> Column:
    """Lines stripped, blank lines dropped."""
    return F.array_join(F.filter(F.transform(F.split(x, "\n"), strip), lambda s: s != ""), "\n")


def trim_to(x: Column, limit: int) -> Column:
    """Stripped; a longer text is cut and ends in three dots."""
    s = strip(x)
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(F.rtrim(F.left(s, F.lit(limit - 3)), F.lit(SPACES)), F.lit("...")))


def strip_latex(x: Column) -> Column:
    """Plain text of LaTeX source, by ordered rewrites."""
    for pattern, to in (
        (r"(?m)(?<!\\)%.*$", ""),
        (r"\\href\{[^}]*\}\{([^}]*)\}", "$1"),
        (r"\\url\{([^}]*)\}", "$1"),
        (r"\\footnote\{[^}]*\}", ""),
        (r"\\(?:label|cite[a-z]*|ref|eqref)\{[^}]*\}", ""),
        (r"\\(?:textbf|textit|emph|texttt|textsc|underline)\{([^}]*)\}", "$1"),
        (r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?", " "),
        (r"[{}]", ""),
        (r"~", " "),
        (r"\s+", " "),
    ):
        x = F.regexp_replace(x, pattern, to)
    return strip(x)


def strip_html(x: Column) -> Column:
    """Text of an HTML page: comments, scripts and styles dropped, tags replaced by a space, five entities decoded."""
    x = F.regexp_replace(x, r"(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " ")
    x = F.regexp_replace(x, r"(?s)<[^>]+>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return F.btrim(F.regexp_replace(x, r"[ \t\n\x0B\f\r]+", " "))


# Addresses and paths.


def urls(x: Column) -> Column:
    """Distinct http(s) addresses in order, without trailing punctuation."""
    return F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit(V.HTTP_URL), F.lit(0)), lambda u: F.rtrim(u, F.lit(V.URL_TAIL))))


def url_host(x: Column) -> Column:
    return F.regexp_extract(x, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)


def url_path(x: Column) -> Column:
    return F.regexp_extract(x, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def repo_key(x: Column, host: str | None = None) -> Column:
    """Canonical https://host/owner/name from an address with two path parts; null otherwise."""
    bare = F.rtrim(F.btrim(x), F.lit(V.URL_TAIL))
    parts = F.filter(F.split(url_path(bare), "/"), lambda p: p != "")
    name = F.regexp_replace(F.get(parts, F.lit(1)), r"\.git$", "")
    out = F.concat(F.lit("https://"), F.lower(url_host(bare)), F.lit("/"), F.get(parts, F.lit(0)), F.lit("/"), name)
    good = bare.rlike("^https?://") & (F.size(parts) >= 2) & (name != "")
    if host:
        good = good & (F.lower(url_host(bare)) == host)
    return F.when(good, out)


def repo_aliases(repo: Column) -> Column:
    parts = F.split(repo, "/")
    return F.array(F.lower(F.element_at(parts, -1)), F.lower(F.concat_ws("/", F.element_at(parts, -2), F.element_at(parts, -1))))


def has_alias(text: Column, alias: Column) -> Column:
    """A bare alias must stand between word boundaries; owner/name may be anywhere."""
    word = F.concat(F.lit(r"\b\Q"), alias, F.lit(r"\E\b"))
    return F.when(F.contains(alias, F.lit("/")), F.contains(text, alias)).otherwise(F.regexp_like(text, word))


def declares_base(readme: Column, aliases: Column) -> Column:
    """Some line holds an alias and one of the phrases that declare a base."""
    def line(s):
        return F.exists(aliases, lambda a: F.contains(s, a)) & any_contains(s, V.BASE_DECLARATIONS)

    return F.exists(F.transform(F.split(F.lower(readme), "\n"), strip), line)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def language(path: Column) -> Column:
    ext = F.substring(extension(path), 2, 20)
    out = F.when(ext == "", "unknown")
    for suffixes, name in V.LANGUAGES:
        out = out.when(ext.isin(*suffixes), name)
    return out.otherwise(ext)


def included_file(path: Column, include_dirs: tuple[str, ...] = ()) -> Column:
    """Whether a path belongs to a repository snapshot."""
    parts = F.split(path, "/")
    name = F.lower(F.element_at(parts, -1))
    good = ~F.startswith(F.element_at(parts, -1), F.lit(".")) & ~F.exists(parts, lambda p: p == ".git")
    good = good & ~F.exists(parts, lambda p: F.lower(p).isin(*V.EXCLUDED_DIRS)) & ~name.isin(*V.EXCLUDED_FILENAMES)
    if include_dirs:
        good = good & F.exists(F.array(*map(F.lit, include_dirs)), lambda d: F.startswith(path, F.concat(d, F.lit("/"))))
    return good & extension(path).isin(*V.EXTENSIONS)


def ancestors(path: Column) -> Column:
    """All proper prefixes of a path, shortest first."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    n = F.size(parts) - 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(
        F.array().cast("array<string>")
    )


def signature_tokens(path: Column) -> Column:
    """Lower-cased path parts and stem of three characters or more, and the suffix."""
    parts = F.filter(F.split(F.lower(path), "/"), lambda p: F.length(p) >= 3)
    stem = F.regexp_replace(F.lower(F.element_at(F.split(path, "/"), -1)), r"\.[^.]*$", "")
    return F.array_union(parts, F.filter(F.array(stem, extension(path)), lambda p: F.length(p) >= 3))


def symbols(code: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(code, F.lit(r"\b(?:class|def)\s+([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)))


def imports(code: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(code, F.lit(r"\b(?:from|import)\s+([A-Za-z_][A-Za-z0-9_\.]*)"), F.lit(1)))


def import_paths(modules: Column) -> Column:
    """Candidate paths of imported modules, in order of module name."""
    def one(m):
        base = F.replace(m, F.lit("."), F.lit("/"))
        return F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py")))

    return F.flatten(F.transform(F.array_sort(modules), one))


def dependency_names(x: Column) -> Column:
    """Names in a requirements file: comments and blanks skipped, cut at the specifier, lower-cased."""
    lines = F.filter(F.transform(F.split(x, "\n"), strip), lambda s: (s != "") & ~F.startswith(s, F.lit("#")))
    names = F.transform(lines, lambda s: F.lower(F.regexp_extract(F.regexp_replace(s, r"^-e\s+", ""), r"^([A-Za-z0-9_.-]+)", 1)))
    return F.array_distinct(F.filter(names, lambda s: s != ""))


def surnames(authors: Column) -> Column:
    last = F.transform(authors, lambda a: F.lower(F.regexp_replace(F.element_at(F.split(F.btrim(a), " "), -1), "[^A-Za-z'-]", "")))
    return F.slice(F.array_distinct(F.filter(last, lambda s: (F.length(s) >= 2) & ~s.isin(*V.SURNAME_SUFFIXES))), 1, 4)


def change_type(haystack: Column, is_new: Column) -> Column:
    """The first rule whose token occurs in the lower-cased path and content."""
    by_word = first_marker(haystack, V.CHANGE_TYPES, "")
    return F.when(by_word != "", by_word).when(is_new, "NEW_MODULE").otherwise("MODIFIED_CORE")


def semantic_tags(haystack: Column) -> Column:
    tags = F.array(*(F.when(any_contains(haystack, words), F.lit(tag)) for tag, words in V.SEMANTIC_TAGS))
    return F.filter(tags, lambda t: t.isNotNull())


def paper_id(x: Column) -> Column:
    """The preprint id in an address or arxiv: reference, without version."""
    return F.nullif(F.regexp_extract(F.btrim(x), r"(?i)(?:arxiv\.org/(?:abs|pdf)/|arxiv:\s*)(\d{4}\.\d{4,5})", 1), F.lit(""))


def paper_kind(x: Column) -> Column:
    s = F.btrim(x)
    return (
        F.when(s == "", F.raise_error(F.lit("empty source")).cast("string"))
        .when(paper_id(s).isNotNull(), "arxiv")
        .when(F.lower(s).rlike(r"^https?://.*\.pdf"), "pdf_url")
        .when(F.endswith(F.lower(s), F.lit(".pdf")), "pdf_file")
        .otherwise("text_reference")
    )


def safe_name(x: Column, default: str = "upload") -> Column:
    s = F.btrim(F.regexp_replace(x, r"[^A-Za-z0-9._-]+", "-"), F.lit("-."))
    return F.when(s == "", default).otherwise(s)


def json_block(x: Column) -> Column:
    """The JSON text of a reply: a fenced block, else from the first [ to the last ], else from { to }."""
    fenced = F.regexp_extract(x, r"(?s)```(?:json)?\s*(.*?)```", 1)
    array = F.regexp_extract(x, r"(?s)(\[.*\])", 1)
    obj = F.regexp_extract(x, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.nullif(strip(fenced), F.lit("")), F.nullif(array, F.lit("")), F.nullif(obj, F.lit("")))


def is_local(x: Column) -> Column:
    """FLT-13: no scheme, or a file address."""
    return F.lower(F.regexp_extract(x, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)).isin("", "file")


def base_classes(code: Column) -> Column:
    """STR-32: base classes of a file's classes, without subscripts and without all but the last qualifier."""
    lists = F.regexp_extract_all(code, F.lit(r"class\s+[A-Za-z_][A-Za-z0-9_]*\(([^)]*)\)"), F.lit(1))
    names = F.flatten(F.transform(lists, lambda x: F.split(x, ",")))
    bare = F.transform(names, lambda n: F.element_at(F.split(strip(F.regexp_replace(n, r"\[.*$", "")), r"\."), -1))
    return F.array_distinct(F.filter(bare, lambda n: n.rlike("^[A-Za-z_][A-Za-z0-9_]*$")))


def case_slug(source: Column, cases) -> Column:
    """STR-48: the first case (slug, aliases) with an alias in the lower-cased source; null if none."""
    return F.nullif(first_marker(F.lower(source), cases, ""), F.lit(""))


def has_marker(x: Column) -> Column:
    """STR-53: a mention of an equation, figure, section or table."""
    return x.rlike(r"(?i)\b(eq|fig|sec|tab)\b")


def cluster_summary(label: Column, files: Column, change_type: Column, rationale: Column) -> Column:
    """STR-52: one sentence on a cluster of changes."""
    return F.format_string("%s: %d file(s) changed as %s (%s).", label, F.size(files), change_type, rationale)
