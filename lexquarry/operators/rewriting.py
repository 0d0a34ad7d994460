"""Looking up what links and figures mean, and rewriting many places of a text through a joined mapping.

Places are numbered in the order they stand. What replaces them is found by joins on narrow rows, gathered by document
as numbers and strings, and put in by one expression over the text, so a text is shuffled at most once and only if
something in it changes. documents(path, ...) have distinct paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexquarry.functions import text as t

# The extensions a figure may have, in the order they are tried, and the folders it may lie in.
FIGURE_EXTENSIONS = (".pdf", ".eps", ".ps", ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tif", ".tiff", ".svg")
FIGURE_FOLDERS = ("figures", "figs", "fig", "images", "img", "plots", "graphics")
GRAPHICS_PATH = r"\\graphicspath\s*\{((?:\s*\{[^{}]*\})+)\s*\}"
INCLUDE_GRAPHICS = r"\\includegraphics\*?\s*(?:\[[^\]]*\]\s*)?\{([^{}]+)\}"
_LINK = r"\]\((?:<[^>\n]+>|[^)\n]+)\)"
_IMAGE = f"{t.MARKDOWN_IMAGE}|{t.IMAGE_TAG}"


def pieces(text: Column, pattern: str) -> Column:
    """The matches of a pattern in a text, in order; what stands around them is F.split(text, pattern, -1)."""
    return F.regexp_extract_all(text, F.lit(pattern), 0)


def put_in(text: Column, pattern: str, new: Column) -> Column:
    """A text with its k-th match replaced by new[k], where that isn't null. new is an array as long as pieces()."""
    around, old = F.split(text, pattern, -1), pieces(text, pattern)
    kept = F.zip_with(old, new, lambda a, b: F.coalesce(b, a))
    return F.array_join(F.zip_with(around, kept, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def replaced(docs: DataFrame, text: str, pattern: str, found: DataFrame) -> DataFrame:
    """The documents that change, with their new text and `n_replaced`: found(path, ord, new) has what the ord-th match
    of a document becomes. A document's replacements are gathered in its own row."""
    new = found.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct(F.col("ord"), F.col("new")))).alias("__new"))
    d = docs.join(new, "path")
    slots = F.transform(F.sequence(F.lit(0), F.size(pieces(F.col(text), pattern)) - 1), lambda k: F.try_element_at("__new", k.cast("int")))
    return d.withColumn(text, put_in(F.col(text), pattern, slots)).withColumn("n_replaced", F.size("__new")).drop("__new")


def normal_path(path: Column) -> Column:
    """A path without empty parts and dots, `..` taken together with the part before it; null if it leads above the top."""
    step = lambda done, x: F.when(x.isin("", "."), done).when(x != "..", F.array_append(done, x)).when(F.size(done) > 0, F.slice(done, 1, F.size(done) - 1))
    return F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step, lambda parts: F.array_join(parts, "/"))


def folder_of(path: Column) -> Column:
    """The folder of a path with its slash, or nothing."""
    return F.regexp_extract(path, r"^(.*/)?[^/]*$", 1)


def _split_extension(path: Column) -> tuple[Column, Column]:
    """A path without extension, and its extension: from the last dot of the last part on, if more than dots stand before."""
    extension = F.regexp_extract(path, r"(?:^|/)\.*[^/.][^/]*?(\.[^./]*)$", 1)
    return F.substr(path, F.lit(1), F.length(path) - F.length(extension)), extension


def figure_targets(docs: DataFrame) -> DataFrame:
    """(path, ord, target) of every \\includegraphics in docs(path, text)."""
    target = F.trim(F.translate(F.trim("target"), '\\"', "/"))
    return docs.select("path", F.posexplode(F.regexp_extract_all("text", F.lit(INCLUDE_GRAPHICS), 1)).alias("ord", "target")).withColumn("target", target)


def figure_folders(docs: DataFrame) -> DataFrame:
    """(path, ord, folder): where a document's figures may lie, in the order to look: its own folder, those named by
    \\graphicspath, and the usual ones beside it. Folders that lead above the top aren't searched."""
    own = folder_of(F.col("path"))
    named = F.flatten(F.transform(F.regexp_extract_all("text", F.lit(GRAPHICS_PATH), 1), lambda x: F.regexp_extract_all(x, F.lit(r"\{([^{}]*)\}"), 1)))
    named = F.filter(F.transform(named, lambda x: F.translate(F.trim(x), "\\", "/")), lambda x: x != "")
    below = F.transform(F.concat(F.array(F.lit("")), named, F.array(*map(F.lit, FIGURE_FOLDERS))), lambda x: F.concat(own, x))
    return docs.select("path", F.posexplode(F.transform(below, normal_path)).alias("ord", "folder")).where("folder IS NOT NULL")


def resolved_figures(targets: DataFrame, folders: DataFrame, files: DataFrame) -> DataFrame:
    """(path, ord, target, file) for targets(path, ord, target), folders(path, ord, folder) and files(path): the first
    existing file by folder, then the target as it is written if it has a figure's extension, then its stem with each
    extension in order. file is null if there is none.

    A target meets files by folder and stem in one equi-join; the extension then only decides the rank.
    """
    stem, extension = _split_extension(F.col("target"))
    d = targets.withColumn("stem", stem).withColumn("extension", extension)
    d = d.join(folders.select("path", F.col("ord").alias("folder_ord"), "folder"), "path", "left")
    d = d.withColumn("key", normal_path(F.concat("folder", F.lit("/"), "stem")))
    file_stem, file_extension = _split_extension(F.col("path"))
    f = files.select(F.col("path").alias("file"), file_stem.alias("key"), file_extension.alias("file_extension")).where(F.lower("file_extension").isin(*FIGURE_EXTENSIONS)).distinct()
    d = d.join(f, "key", "left")
    tried = F.array_position(F.array(*map(F.lit, FIGURE_EXTENSIONS)), F.col("file_extension"))
    rank = F.when(F.col("file_extension") == F.col("extension"), 0).when(tried > 0, tried)
    place = F.when(rank.isNotNull(), F.struct("folder_ord", rank.alias("rank")))
    return d.groupBy("path", "ord", "target").agg(F.min_by("file", place).alias("file"))


def aliases(concepts: DataFrame) -> DataFrame:
    """(alias, name) of concepts(path, aliases): what a dead link may be called, and the file name it means. Of several
    concepts with one alias the last path's counts."""
    d = concepts.select("path", F.explode("aliases").alias("alias")).select(F.translate(F.lower("alias"), " -", "__").alias("alias"), "path")
    return d.groupBy("alias").agg(F.regexp_extract(F.max("path"), "([^/]*)$", 1).alias("name"))


def repairable_links(docs: DataFrame, names: DataFrame, text: str = "raw_text") -> DataFrame:
    """(path, ord, link, new_link): local Markdown links of wiki and inventory documents to files that aren't there, and
    what they become by names(alias, name); new_link is null for those whose stem is no alias."""
    area = F.split_part("path", F.lit("/"), F.lit(1))
    d = docs.where(area.isin("wiki", "inventory")).select("path", F.posexplode(pieces(F.col(text), _LINK)).alias("ord", "link"))
    d = d.withColumn("link", F.regexp_replace("link", r"^\]\(<?|>?\)$", ""))
    target = F.substring_index("link", "#", 1)
    d = d.withColumn("target", target).where("target LIKE '%.md' AND NOT contains(link, '://') AND NOT startswith(link, 'mailto:')")
    at = normal_path(F.when(F.startswith("target", F.lit("/")), F.col("target")).otherwise(F.concat(folder_of(F.col("path")), F.col("target"))))
    d = d.withColumn("at", F.coalesce(at, F.lit(""))).join(docs.select(F.col("path").alias("at")), "at", "left_anti")
    name = F.regexp_extract("target", "([^/]*)$", 1)
    d = d.withColumn("old_name", name).withColumn("alias", F.regexp_replace("old_name", r"\.md$", ""))
    return d.join(names, "alias", "left").select("path", "ord", "link", F.replace("link", F.col("old_name"), F.col("name")).alias("new_link"))


def repaired_links(docs: DataFrame, concepts: DataFrame, text: str = "raw_text") -> DataFrame:
    """The documents with dead links that aliases can repair, with their new text and `n_replaced`; running it again over
    the result changes nothing. concepts(path, aliases) are among docs."""
    found = repairable_links(docs, aliases(concepts), text).where("new_link <> link")
    # a link with blanks keeps its angle brackets
    new = F.when(F.contains("link", F.lit(" ")) | F.contains("new_link", F.lit(" ")), F.concat(F.lit("](<"), "new_link", F.lit(">)"))).otherwise(F.concat(F.lit("]("), "new_link", F.lit(")")))
    return replaced(docs, text, _LINK, found.select("path", "ord", new.alias("new")))


def image_places(docs: DataFrame, text: str = "text") -> DataFrame:
    """(path, ord, before, target, after) of every image, Markdown or HTML; the three parts are the whole place."""
    d = docs.select("path", F.posexplode(pieces(F.col(text), _IMAGE)).alias("ord", "m"))
    markdown = F.startswith("m", F.lit("!"))
    before = F.when(markdown, F.regexp_extract("m", r"^!\[[^\]]*\]\(\s*<?", 0)).otherwise(F.regexp_extract("m", r"""(?is)^.*?\ssrc\s*=\s*["']?""", 0))
    target = F.when(markdown, F.concat(F.regexp_extract("m", t.MARKDOWN_IMAGE, 1), F.regexp_extract("m", t.MARKDOWN_IMAGE, 2))).otherwise(F.concat(*(F.regexp_extract("m", t.SOURCE_ATTRIBUTE, k) for k in (1, 2, 3))))
    d = d.withColumn("before", before).withColumn("target", target)
    return d.select("path", "ord", "before", "target", F.substr("m", F.length("before") + F.length("target") + 1).alias("after"))


def movable_images(docs: DataFrame, text: str = "text") -> DataFrame:
    """image_places() of images that are neither external nor already in the image folder."""
    return image_places(docs, text).where(F.col("target") != "").where(~t.image_kind("target").isin("external", "portable"))


def rewritten_images(docs: DataFrame, names: DataFrame, text: str = "text", prefix: str = "images/") -> DataFrame:
    """The documents whose images names(path, target, name) moves to `<prefix><name>`, with new text and `n_replaced`;
    images without a name stay as they are. Of several names for one target the smallest counts."""
    one = names.groupBy("path", "target").agg(F.min("name").alias("name"))
    found = movable_images(docs, text).join(one, ["path", "target"]).select("path", "ord", F.concat("before", F.lit(prefix), "name", "after").alias("new"))
    return replaced(docs, text, _IMAGE, found)


def image_names(docs: DataFrame, slug: Column, text: str = "text") -> DataFrame:
    """(path, target, name): a name for each movable image of a document, its own under the document's slug."""
    d = movable_images(docs.withColumn("__slug", slug), text).select("path", "target").distinct()
    return d.join(docs.select("path", slug.alias("__slug")), "path").select("path", "target", t.namespaced("__slug", "target").alias("name"))
