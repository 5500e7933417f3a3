"""Text functions of the catalogue as column expressions; all of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and labels that the pages of such a catalogue carry, in two languages.
YEAR_HEADING = r"^(?:Academic Year|Anno Accademico)\s+[0-9]{4}/[0-9]{4}$"
TAIL_LINE = r"(?i)^(Seguici su:|Follow us on:)\s*$"
CREDITS = r"(?i)(?:^|\n)-[ \t]+(?:Credits|Crediti formativi):[ \t]*([0-9]+)\b"
FIELD = r"(?i)(?:^|\n)-[ \t]+(?:{}):[ \t]*([^\n]+)"
SSD_LABELS = "SSD"
LANGUAGE_LABELS = "Language|Lingua di insegnamento"
MODE_LABELS = "Teaching Mode|Modalità didattica"
PERIOD_IT = r"(?i)dal\s+([0-9]{2}/[0-9]{2}/[0-9]{4})\s+al\s+([0-9]{2}/[0-9]{2}/[0-9]{4})"
PERIOD_EN = r"(?i)from\s+([A-Za-z]{3,9}\s+[0-9]{1,2},\s+[0-9]{4})\s+to\s+([A-Za-z]{3,9}\s+[0-9]{1,2},\s+[0-9]{4})"
MODULE_TAIL = r"(?i)\s*\((?:Modulo|Module)\s+[^)]*\)\s*;?\s*$"
# End of fixed values.

_SPACES = r"(?U)[\s\x1c-\x1f]+"
_NEW_LINE = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085  ]"
_BLANK_EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def let(x: Column, body) -> Column:
    """``body(x)`` with x computed once, however often the body names it, also inside functions of arrays."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, _BLANK_EDGES, "")


def clean(x: Column) -> Column:
    """One line: runs of white space of any kind, hard blanks included, become one blank; null stays null."""
    return F.trim(F.regexp_replace(x, _SPACES, " "))


def normalize_lines(x: Column) -> Column:
    """Blanks squeezed within lines, lines stripped, runs of empty lines squeezed to one, the ends stripped."""
    lines = F.transform(F.split(F.replace(x, F.lit(" "), F.lit(" ")), _NEW_LINE), lambda y: strip(F.regexp_replace(y, r"[ \t]+", " ")))
    return strip(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def local_part(email: Column) -> Column:
    """What stands before the first @; all of it where there is none."""
    return F.substring_index(email, "@", 1)


def year_and_id(url: Column) -> Column:
    """struct(year int, id string) from the end of a URL's path, ``/2025/B1234``; null where it does not end so."""
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", ""), "/+$", "")
    year, name = (F.regexp_extract(path, r"/([0-9]{4})/([^/]+)$", k) for k in (1, 2))
    return F.when(year != "", F.struct(year.cast("int").alias("year"), name.alias("id")))


def urls(x: Column) -> Column:
    """Every http(s) URL of a text, in order, without the full stops, commas and brackets after it."""
    return F.transform(F.regexp_extract_all(x, F.lit(r"https?://[^\s)>]+"), F.lit(0)), lambda u: F.regexp_replace(u, "[.,)]+$", ""))


def first_by_language(found: Column, pattern: str, languages: tuple[str, ...] = ("it", "en")) -> Column:
    """struct(language: first URL that ``pattern`` matches with that language as its first group); null unless all are there."""

    def first(language: str) -> Column:
        return F.get(F.filter(found, lambda u: F.regexp_extract(u, f"^(?:{pattern})$", 1) == language), F.lit(0)).alias(language)

    firsts = [first(v) for v in languages]
    both = F.struct(*firsts)
    every = firsts[0].isNotNull()
    for one in firsts[1:]:
        every = every & one.isNotNull()
    return F.when(every, both)


def with_parameter(url: Column, name: str, value: Column) -> Column:
    """The URL with a query parameter set: in its place if it is there, else at the end; other parameters and the fragment stay."""
    fragment = F.regexp_extract(url, "(#.*)$", 1)
    bare = F.regexp_replace(url, "#.*$", "")
    query = F.when(F.instr(bare, "?") > 0, F.regexp_replace(bare, r"^[^?]*\?", "")).otherwise("")
    base = F.regexp_replace(bare, r"\?.*$", "")
    parts = F.filter(F.split(query, "&"), lambda p: p != "")
    own = F.concat(F.lit(f"{name}="), value.cast("string"))
    is_own = lambda p: F.substring_index(p, "=", 1) == name
    replaced = F.when(F.exists(parts, is_own), F.transform(parts, lambda p: F.when(is_own(p), own).otherwise(p))).otherwise(F.concat(parts, F.array(own)))
    return F.concat(base, F.lit("?"), F.array_join(replaced, "&"), fragment)


def letter_url(base: Column, letter: Column, key: str = "initial") -> Column:
    """The URL of a directory's page of one letter; its search term is encoded as a form value."""
    return F.concat(base, F.lit("?mode=people&query="), F.url_encode(F.concat(F.lit(f"+{key}:"), letter)))


# The schemes under which links are relative to their page.
RELATIVE = ("http", "https", "ftp", "file", "sftp", "ws", "wss")
# End of fixed values.


def _url_parts(x: Column) -> dict[str, Column]:
    """Scheme, host, path, query and fragment of a URL; what is not there is empty."""
    whole = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
    parts = {name: F.regexp_extract(x, whole, i) for i, name in enumerate(("scheme", "host", "path", "query", "fragment"), 1)}
    return parts | {"scheme": F.lower(parts["scheme"])}


def _merged_path(base: Column, path: Column) -> Column:
    """A path seen from another, its segments ``.`` and ``..`` resolved: a fold over the segments."""
    folder = F.split(F.regexp_replace(base, "[^/]*$", ""), "/")
    # The last segment of the base goes; an empty one between two others, too.
    before = F.when(F.startswith(path, F.lit("/")), F.array().cast("array<string>")).otherwise(F.slice(folder, 1, F.greatest(F.size(folder) - 1, F.lit(1))))
    every = F.concat(before, F.split(path, "/"))
    inner = F.filter(F.slice(every, 2, F.greatest(F.size(every) - 2, F.lit(0))), lambda s: s != "")
    segments = F.when(F.size(every) < 2, every).otherwise(F.concat(F.slice(every, 1, 1), inner, F.slice(every, -1, 1)))

    def step(done: Column, s: Column) -> Column:
        return F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(s == ".", done).otherwise(F.concat(done, F.array(s)))

    folded = F.aggregate(segments, F.array().cast("array<string>"), step)
    closed = F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(folded, F.array(F.lit("")))).otherwise(folded)
    return F.coalesce(F.nullif(F.array_join(closed, "/"), F.lit("")), F.lit("/"))


def resolved(base: Column, href: Column) -> Column:
    """A link resolved against its page, inside the JVM; an empty link stays empty, one with a malformed host is null.

    As browsers and the usual libraries do it: a link with a host stands for itself, one without a path keeps the page's path and, if
    it has none, its query, and others are merged with the page's path. Schemes that know no relative links leave the link as it is.
    """
    tidy = lambda x: F.regexp_replace(F.regexp_replace(x, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")

    def joined(p: Column) -> Column:
        b, h = _url_parts(p["base"]), _url_parts(p["href"])
        tail = lambda query: F.concat(F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""), F.when(h["fragment"] != "", F.concat(F.lit("#"), h["fragment"])).otherwise(""))
        rooted = lambda path: F.when((path != "") & ~F.startswith(path, F.lit("/")), F.concat(F.lit("/"), path)).otherwise(path)
        slashes = lambda host, path: F.when((host != "") | ((b["scheme"] != "") & ~path.rlike("^[^/]")), F.concat(F.lit("//"), host)).otherwise("")
        head = lambda host, path: F.concat(F.when(b["scheme"] != "", F.concat(b["scheme"], F.lit(":"))).otherwise(""), slashes(host, path), path)
        at_host = lambda path: F.when(b["host"] != "", rooted(path)).otherwise(path)
        odd = h["host"].rlike(r"[\[\]]") & ~h["host"].rlike(r"^([^\[\]@]*@)?\[[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*\](:[0-9]*)?$")
        return (
            F.when(odd, None)
            .when((h["scheme"] != "") & (h["scheme"] != b["scheme"]) | ~b["scheme"].isin("", *RELATIVE), p["given"])
            .when(h["host"] != "", F.concat(head(h["host"], rooted(h["path"])), tail(h["query"])))
            .when(h["path"] == "", F.concat(head(b["host"], at_host(b["path"])), tail(F.when(h["query"] != "", h["query"]).otherwise(b["query"]))))
            .otherwise(let(at_host(_merged_path(b["path"], h["path"])), lambda path: F.concat(head(b["host"], path), tail(h["query"]))))
        )

    page = F.coalesce(base, F.lit(""))
    made = F.struct(tidy(page).alias("base"), tidy(href).alias("href"), href.alias("given"))
    return F.when(href.isNull() | (href == ""), "").when(page == "", href).otherwise(let(made, joined))


def child_url(url: Column, child: str) -> Column:
    """The URL of a page below another."""
    return F.concat(F.regexp_replace(url, "/+$", ""), F.lit("/" + child))


def code_and_description(x: Column) -> Column:
    """struct(name, description) from ``label: CODE some words``; null where nothing follows the label."""
    body = strip(F.regexp_replace(clean(x), "^[^:]*:", ""))
    parts = F.split(body, r"\s+", 2)
    return F.when(body != "", F.struct(F.get(parts, F.lit(0)).alias("name"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("description")))


def detail_value(x: Column) -> Column:
    """A field's value without a module remark at its end and without blanks and semicolons at both."""
    return F.regexp_replace(F.regexp_replace(normalize_lines(x), MODULE_TAIL, ""), "^[ ;]+|[ ;]+$", "")


def unique_values(x: Column, pattern: str) -> Column:
    """The distinct values of a pattern's first group, in the order in which they first come; empty ones left out."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(1)), detail_value), lambda v: v != ""))


def date_value(x: Column) -> Column:
    """A date written 9/9/2025, Sep 9, 2025 or September 9, 2025; null otherwise."""
    y = normalize_lines(x)
    formats = ("d/M/yyyy", "MMM d, yyyy", "MMMM d, yyyy")
    return F.coalesce(*[F.try_to_timestamp(y, F.lit(f)).cast("date") for f in formats])


def schedule(x: Column) -> Column:
    """struct(from, to) over all periods of a text; null where there is none."""
    ends = [F.concat(*[F.transform(F.regexp_extract_all(x, F.lit(p), F.lit(k)), date_value) for p in (PERIOD_IT, PERIOD_EN)]) for k in (1, 2)]
    return F.when(F.size(ends[0]) > 0, F.struct(F.array_min(ends[0]).alias("from"), F.array_max(ends[1]).alias("to")))


def course_details(x: Column) -> Column:
    """struct(credits, ssd, language, teaching_mode, schedule) of a details section. A field ends with its line."""
    field = lambda labels: F.array_join(unique_values(x, FIELD.format(labels)), "; ")
    number = F.regexp_extract(x, CREDITS, 1)
    return F.struct(
        F.when(number != "", number.cast("int")).alias("credits"),
        field(SSD_LABELS).alias("ssd"),
        field(LANGUAGE_LABELS).alias("language"),
        field(MODE_LABELS).alias("teaching_mode"),
        schedule(x).alias("schedule"),
    )


def shorten(x: Column, replacements: tuple[tuple[str, str], ...], longest: int = 38) -> Column:
    """A label: literal replacements in order, then at most ``longest`` characters, the last of them an ellipsis."""
    for old, new in replacements:
        x = F.replace(x, F.lit(old), F.lit(new))
    x = F.replace(x, F.lit("\n"), F.lit(" "))
    return F.when(F.length(x) > longest, F.concat(F.substring(x, 1, longest - 1), F.lit("…"))).otherwise(x)


def single_quotes(x: Column) -> Column:
    """Double quotes as single ones."""
    return F.translate(x, '"', "'")


def digits(x: Column) -> Column:
    """The digits of a file name, for an id where there is no other."""
    return F.regexp_replace(x, "[^0-9]", "")


def without_label(x: Column, label: str) -> Column:
    """A text without the literal label of a link."""
    return F.trim(F.replace(x, F.lit(label), F.lit("")))


def page_count(label: Column) -> Column:
    """The last word of a pager's label as a number; 1 where it is none."""
    return F.coalesce(F.element_at(F.split(F.trim(label), r"\s+"), -1).try_cast("int"), F.lit(1))


def last_with_prefix(parts: Column, prefix: str) -> Column:
    """The last element of an array of texts that begins with a prefix, without it; empty where there is none."""
    found = F.filter(parts, lambda p: F.startswith(p, F.lit(prefix)))
    rest = let(F.get(found, F.size(found) - 1), lambda p: F.trim(F.substring(p, F.lit(len(prefix) + 1), F.length(p))))
    return F.coalesce(rest, F.lit(""))


def url_key(url: Column) -> Column:
    """The key of a page in the page table."""
    return F.sha2(url, 256)


def waits(retries: Column, initial: Column, factor: Column, most: Column) -> Column:
    """The waits before each retry: initial * factor^k, at most ``most``."""
    ks = F.sequence(F.lit(0), retries - 1)
    return F.when(retries > 0, F.transform(ks, lambda k: F.least(initial * F.pow(factor, k), most))).otherwise(F.array().cast("array<double>"))


def course_context(number: Column, title: Column, url: Column) -> Column:
    """A line that says which row a message is about."""
    said = lambda x, name: F.coalesce(F.nullif(F.trim(x), F.lit("")), F.lit(f"<missing {name}>"))
    return F.concat(F.lit("row="), number.cast("string"), F.lit(" title='"), said(title, "title"), F.lit("' url="), said(url, "url"))


def keywords_found(x: Column, keywords: tuple[str, ...]) -> Column:
    """The keywords that a text holds anywhere in it, whatever their case, in the order of the keywords."""
    words = F.array(*[F.lit(k.strip().lower()) for k in keywords if k.strip()]) if keywords else F.array().cast("array<string>")
    return F.filter(words, lambda k: F.contains(F.lower(x), k))


def fetch_status(code: Column) -> Column:
    """What an HTTP status means for a page: ok, skip (404) or fail."""
    return F.when(code == 404, "skip").when(code >= 400, "fail").otherwise("ok")
