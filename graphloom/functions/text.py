"""Text functions as columns; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the punctuation that label texts lose.
LABEL_PUNCTUATION = r"[.,!?;:\"'()\[\]{}…~\-—–_/<>《》〈〉·※ㆍ「」『』]"
# Fixed value: ASCII punctuation that answers lose.
ANSWER_PUNCTUATION = r"[!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"
# Image links in text, endings of image files, the answer call, and where original image files are.
LINK = r"\[\[([^\]]+)\]\]"
IMAGE_FILE = r"(?i)\.(?:png|jpg|jpeg|svg|gif|webp)$"
ANSWER_CALL = r"(?s)f_answers\s*\(\s*\[(.*?)\]\s*\)"
FILE_PATH = "https://en.wikipedia.org/wiki/Special:FilePath/"
# Fixed value: abbreviations that end no sentence.
NOT_AN_END = "Mr|Mrs|Ms|Dr|Prof|St|Jr|Sr|vs|No|Vol|Inc|Ltd|Co|etc|e\\.g|i\\.e|cf"
SENTENCE_END = rf"(?U)(?<!\b(?:{NOT_AN_END}|\p{{Lu}})\.)(?<=[.!?][\"'’”)\]]?)[^\S\n]+(?=[\p{{Lu}}\d\"'‘“(\[])"


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_name(c: Column) -> Column:
    """Letters, digits, space, underscore and hyphen; white space cut at the end."""
    return F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N} _-]", ""), r"(?U)\s+$", "")


def percent_decode(c: Column) -> Column:
    """%xx sequences decoded, `+` left alone; malformed input unchanged."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def url_file(c: Column) -> Column:
    """The decoded last path part of a url."""
    return percent_decode(F.element_at(F.split(F.split_part(c, F.lit("?"), F.lit(1)), "/"), -1))


def without_extension(c: Column) -> Column:
    """The name without its last extension; leading dots belong to the name."""
    return F.regexp_replace(c, r"(?s)^(\.*[^.].*)\.[^.]*$", "$1")


def url_name(c: Column) -> Column:
    return clean_name(without_extension(url_file(c)))


def url_extension(c: Column) -> Column:
    """The last extension in lower case, without the dot; empty without one."""
    return F.lower(F.regexp_extract(url_file(c), r"(?s)^\.*[^.].*\.([^.]*)$", 1))


def save_path(folder: Column, name: Column, extension: Column) -> Column:
    return F.concat(folder, F.lit("/"), clean_name(name), F.lit("."), extension)


def clean_path(c: Column) -> Column:
    """A file path's cleaned name with its extension."""
    base = F.element_at(F.split(c, "/"), -1)
    return F.concat(clean_name(without_extension(base)), F.regexp_extract(base, r"(?s)^\.*[^.].*(\.[^.]*)$", 1))


def basename(c: Column) -> Column:
    return without_extension(F.element_at(F.split(c, "/"), -1))


def wiki_title(c: Column, prefix: str) -> Column:
    """A page title from its url: decoded, the prefix cut off, spaces as underscores."""
    return F.replace(F.replace(percent_decode(c), F.lit(prefix), F.lit("")), F.lit(" "), F.lit("_"))


def label_text(c: Column, punctuation: str = LABEL_PUNCTUATION) -> Column:
    return F.regexp_replace(c, punctuation, " ")


def tokens(c: Column) -> Column:
    """White-space tokens, empty ones dropped."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda t: t != "")


def links(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(LINK), F.lit(1))


def without_links(c: Column) -> Column:
    return strip(F.regexp_replace(c, LINK, ""))


def url_part(c: Column) -> Column:
    """Percent-encoded, as one part of a url's path."""
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


def image_urls(components: Column, prefix: str = FILE_PATH) -> Column:
    """The urls of all image files that components (`src`, `caption`, `paragraph`, `table`) name, distinct and in order: in `src`, or as
    [[...]] in a text or a table cell. A name without an address is a file at `prefix`."""
    texts = F.flatten(F.transform(components, lambda c: F.concat(F.array(c["caption"], c["paragraph"]), F.coalesce(F.flatten(F.filter(c["table"], lambda r: r.isNotNull())), F.array().cast("array<string>")))))
    named = F.flatten(F.transform(F.filter(texts, lambda t: t.isNotNull()), links))
    sources = F.filter(F.transform(components, lambda c: c["src"]), lambda s: s.isNotNull())
    files = F.filter(F.transform(F.concat(sources, named), strip), lambda n: F.regexp_like(n, F.lit(IMAGE_FILE)))

    def address(name: Column) -> Column:
        whole = F.when(F.startswith(name, F.lit("//")), F.concat(F.lit("https:"), name)).otherwise(name)
        return F.when(F.contains(whole, F.lit("://")), whole).otherwise(F.concat(F.lit(prefix), F.regexp_replace(whole, r"^(\./)?File:", "")))

    return F.array_sort(F.array_distinct(F.transform(files, address)))


def file_path_url(resource: Column, src: Column, prefix: str = FILE_PATH) -> Column:
    """The original file of an image: from its resource name, else from an upload or its thumbnail; another
    address stays as it is. Null without any."""
    named = percent_decode(F.regexp_replace(resource, r"(?:\./)?File:", ""))
    raw = F.regexp_replace(strip(src), "^//", "https://")
    parts = F.split(raw, "/")
    upload = percent_decode(F.when(F.contains(raw, F.lit("/thumb/")), F.element_at(parts, -2)).otherwise(F.element_at(parts, -1)))
    return (
        F.when(F.length(resource) > 0, F.concat(F.lit(prefix), named))
        .when(F.contains(raw, F.lit("upload.wikimedia.org")), F.concat(F.lit(prefix), upload))
        .when(F.length(raw) > 0, raw)
    )


def remove_newlines(c: Column) -> Column:
    return F.replace(c, F.lit("\n"), F.lit(""))


def component_prefix(title: Column, heading_path: Column) -> Column:
    return F.concat(title, F.lit(" [SEP] "), F.array_join(heading_path, " , "), F.lit(" [SEP] "))


def image_text(prefix: Column, caption: Column, explanation: Column, ocr: Column) -> Column:
    """The prefix with the caption, then the explanation and the OCR text where they aren't empty."""

    def some(c: Column) -> Column:
        return F.when(F.length(c) > 0, F.concat(F.lit(" [SEP] "), c)).otherwise("")

    return F.concat(prefix, F.coalesce(caption, F.lit("")), some(explanation), some(ocr))


def paragraphs(c: Column) -> Column:
    """Non-empty lines as sentences; the whole text, or one space, where there are none."""
    parts = F.filter(F.transform(F.split(c, "\n"), lambda s: F.trim(s)), lambda s: s != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.when(F.length(c) > 0, c).otherwise(F.lit(" "))))


def sentences(c: Column) -> Column:
    """Sentences of each line: they end in `.`, `!` or `?` before white space and a capital, a digit or an opening
    mark, but not after a usual abbreviation or a single initial. The whole text, or one space, without any."""
    cut = F.regexp_replace(c, SENTENCE_END, "\n")
    return paragraphs(cut)


def table_for_labels(table: Column) -> Column:
    """All cells without image links, joined by spaces; empty cells dropped."""
    cells = F.transform(F.flatten(table), without_links)
    return F.array_join(F.filter(cells, lambda x: x != ""), " ")


def flatten_table(table: Column, images: Column | None = None) -> Column:
    """Cells by spaces, rows by ` [SEP] `; then ` [SEP] <Image i> name explanation` for each image.

    `images`: array of (name, explanation) of the table's images that exist, in order.
    """
    rows = F.transform(table, lambda r: F.array_join(F.filter(F.transform(r, without_links), lambda x: x != ""), " "))
    text = F.array_join(rows, " [SEP] ")
    if images is None:
        return text
    tagged = F.transform(
        images, lambda x, i: F.concat(F.lit(" [SEP] <Image "), (i + 1).cast("string"), F.lit("> "), x["name"], F.lit(" "), x["explanation"])
    )
    return F.concat(text, F.array_join(tagged, ""))


def table_subcomponents(table: Column) -> Column:
    """Up to two rows one sub-component; else the header with each further row."""
    rest = F.transform(F.slice(table, 2, F.greatest(F.size(table) - 1, F.lit(1))), lambda r: F.array(table[0], r))
    return F.when(F.size(table) <= 2, F.array(table)).otherwise(rest)


def parse_answers(c: Column) -> Column:
    """The quoted strings of the first f_answers([...]); the stripped output where there is none."""
    inner = F.regexp_extract(c, ANSWER_CALL, 1)
    quoted = F.transform(F.regexp_extract_all(inner, F.lit("[\"'](.*?)[\"']"), F.lit(1)), strip)
    return F.when(F.regexp_like(c, F.lit(ANSWER_CALL)), quoted).otherwise(F.array(strip(c)))


def normalize_answer(c: Column) -> Column:
    bare = F.regexp_replace(F.lower(c), ANSWER_PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "), r"(?U)\s+", " "))


def modality(c: Column, allowed: tuple[str, ...] = ("text", "table", "image")) -> Column:
    key = F.replace(F.lower(strip(c)), F.lit("."), F.lit(""))
    return F.when(key.isin(*allowed), key).otherwise("text")


def subqueries(c: Column) -> Column:
    parts = F.transform(F.split(F.replace(c, F.lit("\n"), F.lit("")), ";"), strip)
    return F.filter(parts, lambda x: x != "")


def prompt_cell(c: Column) -> Column:
    """Commas stand between spaces; links are cut out."""
    return F.regexp_replace(without_links(c), r"\s*,\s*", " , ")


def rate(c: Column) -> Column:
    return F.format_string("%.4f", c)


def percent(c: Column) -> Column:
    """A share of 100 as a text."""
    return F.format_string("%.2f%%", c)


def scaled_size(width: Column, height: Column, pixels: int = 512 * 512) -> Column:
    """Width and height of at most `pixels` with the ratio kept, rounded half to even."""
    scale = F.sqrt(F.lit(float(pixels)) / (width * height))
    small = width * height <= pixels
    return F.struct(
        F.when(small, width).otherwise(F.bround(width * scale).cast("int")).alias("width"),
        F.when(small, height).otherwise(F.bround(height * scale).cast("int")).alias("height"),
    )


def clamped_box(box: Column, width: Column, height: Column) -> Column:
    """A box inside an image; null where nothing is left of it."""
    x1, y1 = F.greatest(F.lit(0), F.least(box[0], width - 1)), F.greatest(F.lit(0), F.least(box[1], height - 1))
    x2, y2 = F.greatest(F.lit(0), F.least(box[2], width)), F.greatest(F.lit(0), F.least(box[3], height))
    return F.when((x2 > x1) & (y2 > y1), F.array(x1, y1, x2, y2))
