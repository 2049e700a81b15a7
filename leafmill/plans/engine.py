"""The public face: documents in, tables out."""

from __future__ import annotations

import importlib.metadata
import logging
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill import __version__ as VERSION
from leafmill.config import GridOptions, Options
from leafmill.functions.geometry import box, expanded
from leafmill.functions.text import quality
from leafmill.operators import assemble, blocks, cuts, layout, ocr, reading, status
from leafmill.operators import tables as grids
from leafmill.sources import backends, formats, markup, pixels
from leafmill.storage import stored

PAGE = ["doc_id", "page_no"]

_stages: dict[tuple[str, type], Callable] = {("table", GridOptions): grids.stage}


def register_stage(kind: str, options_type: type, run: Callable[..., DataFrame]) -> None:
    """Register a plug-in stage (ocr, layout, table, figure, enrichment) for its options type; a second one is an error."""
    if (kind, options_type) in _stages:
        raise ValueError(f"a {kind} stage for {options_type.__name__} is registered already")
    _stages[kind, options_type] = run


def stage_for(kind: str, options: object) -> Callable[..., DataFrame]:
    if (kind, type(options)) not in _stages:
        known = sorted(t.__name__ for k, t in _stages if k == kind)
        raise ValueError(f"no {kind} stage for {type(options).__name__}; registered: {known}")
    return _stages[kind, type(options)]


def load_stages(allow_external: bool = False, group: str = "leafmill.stages") -> dict[str, str]:
    """Register the stages that installed packages offer, and say for each entry point what became of it.

    An entry point of ``group`` names a function that returns ``(kind, options type, run)`` tuples. Those of other packages than
    this one are not even imported unless ``allow_external``; a stage whose place is taken is left out with a warning.
    """
    told = {}
    for point in importlib.metadata.entry_points(group=group):
        if not allow_external and point.module.partition(".")[0] != __name__.partition(".")[0]:
            told[point.name] = "refused"
            logging.getLogger(__name__).warning("plug-in %s is not loaded: external plug-ins are not allowed", point.name)
            continue
        told[point.name] = "loaded"
        for kind, options_type, run in point.load()():
            try:
                register_stage(kind, options_type, run)
            except ValueError as e:
                told[point.name] = "in part"
                logging.getLogger(__name__).warning("plug-in %s: %s", point.name, e)
    return told


@dataclass(frozen=True)
class Conversion:
    """Tables of one conversion. Clusters and reading order are written once; the rest is lazy."""

    results: DataFrame
    items: DataFrame
    children: DataFrame
    pages: DataFrame
    confidence: DataFrame
    regions: DataFrame
    #: (key, scope, elapsed, n_rows) of each stage that was run: wall seconds, and the rows that it wrote
    timings: DataFrame
    #: (doc_id, page_no, n_lines, has_lines, ...) of each page: the cells that stages may use, by lines, words and characters
    cell_flags: DataFrame


class Stopwatch:
    """Writes the tables of a conversion, and notes what each took."""

    def __init__(self) -> None:
        self.began, self.took = time.perf_counter(), []

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        """The seconds are those since the table before, so nothing that ran is left out; rows are counted by the files' footers,
        as an observation is never told of a plan that turns out to be empty.
        """
        out = stored(df, name)
        n_rows, now = out.count(), time.perf_counter()
        self.took.append((name, "stage", now - self.began, n_rows))
        self.began = now
        return out

    def timings(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.took, "key string, scope string, elapsed double, n_rows long")


class Overrun(RuntimeError):
    """The wall-clock limit was reached; what ran has been interrupted."""


def within(spark: SparkSession, limit: float | None, work: Callable[[], Conversion]) -> Conversion:
    """Run ``work``; after ``limit`` seconds its jobs, found by a tag of their own, are interrupted, and no others."""
    if limit is None:
        return work()
    tag, over, context = f"leafmill-{uuid.uuid4().hex}", threading.Event(), spark.sparkContext

    def stop() -> None:
        over.set()
        while not ended.is_set():  # a job that is begun meanwhile ends too
            context.cancelJobsWithTag(tag)
            ended.wait(0.2)

    ended = threading.Event()
    timer = threading.Timer(limit, stop)
    timer.daemon = True
    context.addJobTag(tag)
    timer.start()
    try:
        return work()
    except Exception as e:
        if over.is_set():
            raise Overrun(f"{limit} seconds are over") from e
        raise
    finally:
        ended.set()
        timer.cancel()
        context.removeJobTag(tag)


@dataclass(frozen=True)
class Declared:
    """Results and items of documents that declare their structure."""

    results: DataFrame
    items: DataFrame


class Engine:
    """Converts tables of documents: ``inputs`` with doc_id, file, filesize, page_count; their cells and detections."""

    def __init__(self, options: Options = Options()):
        self.options = options

    def _staged(self, kind: str, options: object, given: DataFrame | None, *inputs: DataFrame) -> DataFrame | None:
        """A given table, or else what the stage registered for these options makes of its inputs; None without either."""
        if given is not None or (kind, type(options)) not in _stages:
            return given
        return stage_for(kind, options)(*inputs, options)

    def _outcome(self, expected: DataFrame, pages: DataFrame, cells: DataFrame, detections: DataFrame) -> DataFrame:
        """``(doc_id, page_no, ok, error, timed_out)`` of every expected page: ok is null if it was never begun.

        A page fails through its backend, an error that its reader noted, or rows that no stage can use; it never ends the job.
        """
        o = self.options
        error = F.col("error") if "error" in pages.columns else F.lit(None).cast("string")
        spent = F.coalesce(F.col("elapsed").cast("double"), F.lit(0.0)) if "elapsed" in pages.columns else F.lit(0.0)
        seen = pages.select("doc_id", "page_no", F.coalesce(error, F.when(~F.col("backend_ok"), "page backend failed")).alias("error"), spent.alias("elapsed"))
        holes = [t.filter(F.greatest(*(F.isnull(c).cast("int") for c in need)) == 1).select("doc_id", "page_no", F.lit(name).alias("fault")) for t, need, name in ((cells, ("idx", "text", *"ltrb"), "cell without text or box"), (detections, ("id", "label", *"ltrb", "conf"), "detection without label, box or confidence"))]
        faults = holes[0].union(holes[1]).groupBy("doc_id", "page_no").agg(F.min("fault").alias("fault"))
        known = expected.join(seen, PAGE, "left").join(faults, PAGE, "left").withColumn("known", F.col("elapsed").isNotNull())
        fault = F.coalesce("error", "fault", F.when(~F.col("known"), "page is missing"))
        if o.document_timeout is None:
            return known.select(*PAGE, fault.isNull().alias("ok"), fault.alias("error"), F.lit(False).alias("timed_out"))
        known = status.timed(known, o.document_timeout)
        return known.select(*PAGE, (F.col("fed") & fault.isNull()).alias("ok"), F.when(F.col("fed"), fault).otherwise("document timeout exceeded").alias("error"), "timed_out")

    def convert_all(
        self, inputs: DataFrame, cells: DataFrame, detections: DataFrame | None, pages: DataFrame, bitmaps: DataFrame | None = None, ocr_cells: DataFrame | None = None,
        table_predictions: DataFrame | None = None, figure_predictions: DataFrame | None = None, raises_on_error: bool | None = None,
    ) -> Conversion:
        """Admission, OCR merging, layout clean-up, assembly, reading order, confidence and status of every document.

        Cells may be lines, words and characters (``granularity``; without it all are lines): texts are made of lines, and ``cell_flags`` tells
        what a page has. Detections, OCR cells, tables and figures come as tables, or from the stages registered for ``options.layout``, ``.ocr``,
        ``.table`` and ``.figure``; without bitmaps no page is read by OCR. If ``options.wall_clock_limit`` seconds are over before the
        stages have run, they are interrupted: every admitted document is a partial success without items, its pages errors.
        """
        given = (inputs, cells, detections, pages, bitmaps, ocr_cells, table_predictions, figure_predictions)
        o = self.options
        try:
            return within(cells.sparkSession, o.wall_clock_limit, lambda: self._converted(*given, raises_on_error=raises_on_error))
        except Overrun:
            nothing = Engine(replace(o, wall_clock_limit=None))._converted(*(t if t is None else t.limit(0) for t in given), raises_on_error=False)
            docs = self._admitted(inputs)
            expected = formats.expand_pages(docs.filter("status = 'pending'"), o.limits).select(*PAGE)
            cut = expected.select(*PAGE, F.lit(False).alias("ok"), F.lit("wall-clock limit exceeded").alias("error"))
            made = status.document_status(cut, F.lit(True)).join(status.page_errors(cut), "doc_id", "left").withColumnRenamed("status", "page_status")
            results = docs.join(made, "doc_id", "left").withColumn("status", F.when(F.col("status") == "pending", F.coalesce("page_status", F.lit("failure"))).otherwise(F.col("status"))).drop("page_status")
            return replace(nothing, results=nothing.results.unionByName(results, allowMissingColumns=True))

    def _admitted(self, inputs: DataFrame) -> DataFrame:
        """Inputs with format, validity and a first status."""
        o = self.options
        if "format" not in inputs.columns:
            mime, fmt = formats.detect_format(F.col("file"))
            inputs = inputs.withColumn("mime", mime).withColumn("format", fmt)
        return formats.gate(formats.admit(inputs, o.limits), o.allowed_formats or formats.FORMATS)

    def _converted(
        self, inputs: DataFrame, cells: DataFrame, detections: DataFrame | None, pages: DataFrame, bitmaps: DataFrame | None, ocr_cells: DataFrame | None,
        table_predictions: DataFrame | None, figure_predictions: DataFrame | None, raises_on_error: bool | None,
    ) -> Conversion:
        o, watch = self.options, Stopwatch()
        detections = self._staged("layout", o.layout, detections, pages)
        if detections is None:
            raise ValueError("no detections, and no layout stage is registered for these options")
        docs = self._admitted(inputs)
        expected = formats.expand_pages(docs.filter("status = 'pending'"), o.limits).select(*PAGE)
        outcome = watch.stored(self._outcome(expected, pages, cells, detections), "page-outcome")
        done = outcome.filter("ok").select(*PAGE)
        todo, own, dets = (t.join(done, PAGE, "left_semi") for t in (pages, cells, detections))
        own, fine = ocr.by_unit(own)
        found = None
        if bitmaps is not None:
            rects = ocr.bitmap_rects(bitmaps.join(done, PAGE, "left_semi"))
            decided = ocr.decide(ocr.coverage(rects, todo), o.ocr)
            found = ocr.regions(rects, todo)
            read = self._staged("ocr", o.ocr, ocr_cells, decided, found)
            if read is not None:
                read, forced = ocr.in_regions(ocr.accepted(read.join(done, PAGE, "left_semi"), o.ocr), decided, found), o.ocr.force_full_page_ocr
                read, fine_read = ocr.by_unit(read if forced else ocr.without_covered(read, own))
                own, fine = ocr.combine(own, read, forced), ocr.finer(fine, fine_read, forced)
        own = watch.stored(own, "merged-cells")
        regular, special, kids = layout.clean(dets.filter(F.col("conf") >= o.score_threshold), own, todo, o.layout)
        special = layout.deoverlapped(special)
        clusters = watch.stored(layout.ordered(layout.final(regular, special, kids)), "final-clusters")
        routed = assemble.routed(clusters)
        tables = self._staged("table", o.table, table_predictions, routed.filter("kind = 'table'"), own)
        figures = self._staged("figure", o.figure, figure_predictions, routed.filter("kind = 'figure'"))
        elements = routed.drop("cells")
        elements = elements.withColumns({"num_rows": F.lit(0).cast("long"), "num_cols": F.lit(0).cast("long")}) if tables is None else assemble.with_tables(elements, tables)
        elements = elements.withColumn("figure_class", F.lit(None).cast("string")) if figures is None else assemble.with_figures(elements, figures)
        placed = cuts.reading_order(elements, todo, o.reading.slack) if o.reading.method == "cuts" else reading.reading_order(elements, todo)
        ordered = watch.stored(assemble.with_texts(placed, assemble.line_texts(routed, own)), "reading-order")
        items = reading.items(ordered).join(ordered.select("doc_id", "seq", "num_rows", "num_cols", "figure_class"), ["doc_id", "seq"])
        items = self._enriched(items, ordered)
        children = reading.child_items(kids, ordered.select(*PAGE, "id", "kind", "num_rows"), own)
        parse = own.filter(~F.col("from_ocr")).withColumn("q", quality(F.col("text"))).groupBy(*PAGE).agg(F.expr("percentile(q, 0.1)").alias("parse_score"))
        scored = layout.page_scores(clusters, own, todo).join(parse, PAGE, "left")
        if tables is not None and "score" in tables.columns:
            scored = scored.join(tables.groupBy(*PAGE).agg(F.avg("score").alias("table_score")), PAGE, "left")
        else:
            scored = scored.withColumn("table_score", F.lit(None).cast("double"))
        confidence = status.page_confidence(scored)
        made = status.document_status(outcome, F.col("timed_out")).join(status.page_errors(outcome), "doc_id", "left")
        made = made.join(status.document_confidence(confidence), "doc_id", "left").withColumnRenamed("status", "page_status")
        results = docs.join(made, "doc_id", "left").withColumn("status", F.when(F.col("status") == "pending", F.coalesce("page_status", F.lit("failure"))).otherwise(F.col("status"))).drop("page_status")
        if o.raises_on_error if raises_on_error is None else raises_on_error:
            status.raise_unless_ok(results)
        lines = own.select(*PAGE, F.lit("line").alias("granularity"))
        flags = ocr.page_flags(lines if fine is None else lines.union(fine.select(*PAGE, "granularity")), todo)
        return Conversion(results, items, children, reading.all_pages(expected, todo), confidence, found if found is not None else done.limit(0), watch.timings(cells.sparkSession), flags)

    def convert_files(self, spark: SparkSession, path: str, **settings) -> Conversion:
        """Every file below ``path``, on any store that Spark reads (it lists no file of no bytes). doc_id: a hash of the path, which
        ``results`` has as ``path``.
        """
        files = formats.read_files(spark, path).withColumn("doc_id", F.xxhash64("path"))
        return self.convert_contents(files, **settings)

    def convert_streams(self, rows: DataFrame, content_col: str, name_col: str, **settings) -> Conversion:
        """Rows ``(doc_id, name, bytes)``; formats by the leading bytes, else by the name."""
        return self.convert_contents(formats.from_streams(rows, content_col, name_col).withColumn("content", F.coalesce(F.col(content_col), F.lit(b""))), **settings)

    def convert_contents(self, files: DataFrame, backend_options: dict[str, str] | None = None, raises_on_error: bool | None = False) -> Conversion:
        """Input documents with ``content``: pages by the backend of their format, proposals by the layout stage registered, or from
        the lines themselves, then as ``convert_all``. What cannot be opened, and pages that cannot be read, are errors of their document.

        Contents are read twice, for their pages and for what is told of each file; both are written, as several stages read them. Files
        that are too large or not of an allowed format are not opened.
        """
        o = self.options
        wanted = F.coalesce(F.col("format").isin(*(o.allowed_formats or formats.FORMATS)), F.lit(False))
        if o.limits.enforce_file_size:
            wanted &= F.col("filesize") <= o.limits.max_file_size
        opened = files.filter(wanted).select(F.col("doc_id").cast("string").alias("file"), "format", "content")
        made = stored(backends.read_pages(opened, backend_options), "read-pages")
        made = made.withColumn("doc_id", F.col("file").cast("long")).drop("file")
        read = made.filter("page_no is not null")
        pages = read.select(*PAGE, "width", "height", F.lit(True).alias("backend_ok"), "error")
        cells = read.select(*PAGE, F.explode("cells").alias("x")).select(*PAGE, "x.*", F.lit(False).alias("from_ocr"), F.lit(1.0).alias("conf"))
        bitmaps = read.select(*PAGE, F.explode("bitmaps").alias("x")).select(*PAGE, "x.*")
        counts = made.groupBy("doc_id").agg(F.max("page_no").alias("page_count"), F.max(F.when(F.isnull("page_no"), F.col("error"))).alias("open_error"))
        inputs = stored(files.drop("content"), "read-files").join(counts, "doc_id", "left")
        detections = None if ("layout", type(o.layout)) in _stages else blocks.proposals(cells)
        return self.convert_all(inputs, cells, detections, pages, bitmaps, raises_on_error=raises_on_error)

    def images(self, conversion: Conversion, files: DataFrame) -> DataFrame:
        """Pictures, as PNG at ``options.images_scale``, of what the options ask for: whole pages, tables, figures.

        ``(doc_id, item_ref, page_no, width, height, dpi, png, error)``; item_ref is null for a page. ``files`` (doc_id, content) are those that
        were converted. Pages without a size have no picture.
        """
        o = self.options
        sized = conversion.pages.filter("not missing").select(*PAGE, F.col("width").alias("page_width"), F.col("height").alias("page_height"))
        kinds = [k for k, on in (("table", o.table_images), ("figure", o.figure_images)) if on]
        p = F.col("prov")[0]
        own = conversion.items.filter(F.col("type").isin(*kinds)).select("doc_id", p["page_no"].alias("page_no"), "item_ref", *(p[c].alias(c) for c in "ltrb"))
        own = own.join(sized, PAGE).withColumns({"t": F.col("page_height") - F.col("t"), "b": F.col("page_height") - F.col("b")})
        own = own.withColumn("id", F.substring_index("item_ref", "/", -1).cast("int"))
        if o.page_images:
            whole = sized.select(*PAGE, F.lit(None).cast("string").alias("item_ref"), F.lit(0.0).alias("l"), F.lit(0.0).alias("t"), F.col("page_width").alias("r"), F.col("page_height").alias("b"), "page_width", "page_height", F.lit(-1).alias("id"))
            own = own.unionByName(whole)
        made = pixels.images(files, own, o.images_scale)
        ref = F.when(F.col("id") >= 0, reading.ref_of(F.col("page_no"), F.col("id")))
        return made.select("doc_id", ref.alias("item_ref"), "page_no", "width", "height", "dpi", "png", "error")

    def convert(self, doc_id: int, inputs: DataFrame, cells: DataFrame, detections: DataFrame, pages: DataFrame, **tables: DataFrame) -> Conversion:
        """One document: the filter reaches every scan. Further tables as for ``convert_all``."""
        one = [t.filter(F.col("doc_id") == doc_id) for t in (inputs, cells, detections, pages)]
        return self.convert_all(*one, **{name: t.filter(F.col("doc_id") == doc_id) for name, t in tables.items()})

    def _enriched(self, items: DataFrame, ordered: DataFrame) -> DataFrame:
        """Adds ``enrichment``: what the stage registered for ``options.enrichment`` says of items of its types, from their
        boxes (grown by ``expansion`` of their size) and texts; null without a stage."""
        o = self.options.enrichment
        if ("enrichment", type(o)) not in _stages:
            return items.withColumn("enrichment", F.lit(None).cast("string"))
        grown = expanded(box(), o.expansion)
        crops = ordered.select(*PAGE, "seq", *(x.alias(c) for x, c in zip(grown, "ltrb", strict=True)))
        wanted = items.filter(F.col("type").isin(*o.types)).select("doc_id", "seq", "type", "text").join(crops, ["doc_id", "seq"])
        return items.join(stage_for("enrichment", o)(wanted, o).select("doc_id", "seq", "enrichment"), ["doc_id", "seq"], "left")

    def convert_string(self, rows: DataFrame, content_col: str, fmt: str, name_col: str | None = None) -> Declared:
        """Rows ``(doc_id, text)`` of HTML or Markdown: each row's result and its items with their parents."""
        files = formats.from_strings(rows, content_col, fmt, name_col)
        return self.convert_markup(files, content_col)

    def convert_markup(self, files: DataFrame, content_col: str) -> Declared:
        """Input documents of a declarative format: nothing is laid out, structure comes from the markup. Items are written once."""
        made = stored(markup.items(files, "doc_id", content_col, "format"), "markup-items")
        ref = lambda c: F.concat(F.lit("#/"), F.col(c).cast("string"))
        items = made.filter("error is null").select("doc_id", F.col("ord").alias("seq"), ref("ord").alias("item_ref"), F.coalesce(ref("parent"), ref("heading")).alias("parent_ref"), "type", "level", F.col("layer").alias("content_layer"), "row", "col", "row_span", "col_span", "text")
        errors = made.filter("error is not null").groupBy("doc_id").agg(F.min("error").alias("error"))
        status = F.when(F.col("error").isNull(), "success").otherwise("failure")
        return Declared(files.drop(content_col).join(errors, "doc_id", "left").withColumn("status", status), items)


_engines: dict[str, Engine] = {}


def engine_for(options: Options) -> Engine:
    """The engine of these options; equal options share one."""
    return _engines.setdefault(options.key(), Engine(options))


#: Members of a saved document.
MEMBERS = "version string, saved_at string, origin struct<mimetype:string,filename:string,binary_hash:string>, status string, errors array<struct<component_type:string,module_name:string,error_message:string>>, pages array<struct<page_no:int,width:double,height:double,missing:boolean>>, timings array<struct<key:string,scope:string,n:long,total:double>>, confidence struct<parse_score:double,layout_score:double,table_score:double,ocr_score:double,mean_score:double,low_score:double,mean_grade:string,low_grade:string>"


def origin(results: DataFrame) -> Column:
    """Where a document comes from: MIME type, file name and content hash, each null where the inputs did not have it."""
    given = lambda *names: F.coalesce(*(F.col(n).cast("string") for n in names if n in results.columns), F.lit(None).cast("string"))
    return F.struct(given("mime").alias("mimetype"), given("name", "file").alias("filename"), given("document_hash").alias("binary_hash"))


def saved(conversion: Conversion, timings: DataFrame | None = None) -> DataFrame:
    """``(doc_id, value)``: one JSON text a document with version, time, origin, status, errors, pages, timings, confidence and items."""
    r = conversion.results
    pages = conversion.pages.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_no", "width", "height", "missing"))).alias("pages"))
    body = conversion.items.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "item_ref", "parent_ref", "type", "content_layer", "text", "orig", "prov", "caption_refs", "footnote_refs"))).alias("document"))
    scores = F.struct("parse_score", "layout_score", "table_score", "ocr_score", "mean_score", "low_score", "mean_grade", "low_grade").alias("confidence")
    out = r.select("doc_id", origin(r).alias("origin"), "status", "errors", scores).join(pages, "doc_id", "left").join(body, "doc_id", "left")
    if timings is None:
        out = out.withColumn("timings", F.lit(None))
    else:
        took = timings.groupBy("doc_id", "key", "scope").agg(F.count("*").alias("n"), F.sum("elapsed").alias("total"))
        out = out.join(took.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("key", "scope", "n", "total"))).alias("timings")), "doc_id", "left")
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    members = F.struct(F.lit(VERSION).alias("version"), stamp.alias("saved_at"), "origin", "status", "errors", "pages", "timings", "confidence", "document")
    return out.select("doc_id", F.to_json(members).alias("value"))


def save(conversion: Conversion, path: str, timings: DataFrame | None = None) -> None:
    """Write ``saved`` as JSON lines of ``(doc_id, value)``."""
    saved(conversion, timings).write.mode("overwrite").json(path)


def load(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Saved documents by ``schema`` (default: all members but the items); members that are missing, and texts that are no JSON, come back null."""
    rows = spark.read.schema("doc_id long, value string").json(path)
    return rows.select("doc_id", F.from_json("value", schema or MEMBERS, {"mode": "PERMISSIVE"}).alias("r")).select("doc_id", "r.*")


def summaries(conversion: Conversion) -> DataFrame:
    """``(doc_id, summary)``: status, errors, page count, size and items of each document as JSON."""
    body = conversion.items.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "type", "text"))).alias("document"))
    rows = conversion.results.join(body, "doc_id", "left")
    return rows.select("doc_id", F.to_json(F.struct("status", "errors", "page_count", "filesize", "document")).alias("summary"))
