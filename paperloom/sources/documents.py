"""A data source for folders of documents: texts, DOCX files and words of pages extracted beforehand, with dead letters."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import PurePosixPath

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.types import StructType

FORMAT = "paperloom_documents"
SCHEMA = "source string, kind string, bytes long, page int, text string, error string"
FILES = 64  # files of a partition


class Files(InputPartition):
    def __init__(self, paths: list[tuple[str, int]]) -> None:
        self.paths = paths


class DocumentReader(DataSourceReader):
    """Reads files a partition at a time; which columns are asked for decides whether a file is opened at all."""

    def __init__(self, schema: StructType, options: dict) -> None:
        self.names = schema.fieldNames()
        self.options = options
        self.equal: dict[str, object] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Equality of source and kind chooses files; other filters are left to Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute in (("source",), ("kind",)):
                self.equal[f.attribute[0]] = f.value
            else:
                yield f

    def partitions(self) -> list[Files]:
        import pyarrow.fs as pafs

        fs, root = pafs.FileSystem.from_uri(self.options["path"])
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.is_file and not f.base_name.startswith((".", "_")))
        files = [f for f in files if all(self.told(f[0])[c] == v for c, v in self.equal.items())]
        n = int(self.options.get("files", FILES))
        return [Files(files[i : i + n]) for i in range(0, max(1, len(files)), n)]  # Spark reads one, be it empty

    @staticmethod
    def told(path: str) -> dict:
        """What a path tells of a file."""
        p = PurePosixPath(path)
        return {"source": p.name, "kind": p.suffix.lower().lstrip(".")}

    def read(self, partition: Files) -> Iterator[tuple]:
        import pyarrow.fs as pafs

        fs, _ = pafs.FileSystem.from_uri(self.options["path"])
        inside = bool({"text", "page", "error"} & set(self.names))
        for path, size in partition.paths:
            known = self.told(path) | {"bytes": size}
            for page, text, error in self.pages(fs, path, known["kind"]) if inside else [(None, None, None)]:
                row = known | {"page": page, "text": text, "error": error}
                yield tuple(row[c] for c in self.names)

    def pages(self, fs, path: str, kind: str) -> Iterator[tuple]:
        """(page, text, error): one for a text or DOCX file, one for each page of words, in order; a file that can't be read is
        one row that says why. An empty file is an empty text."""
        from paperloom.sources.files import docx_text

        try:
            if kind not in ("txt", "docx", "words"):
                raise ValueError(f"unsupported extension: {kind}")
            with fs.open_input_stream(path) as f:
                content = f.read()
            if kind == "words":
                yield from [(page, text, None) for page, text in sorted(self.words(content).items())]
            else:
                yield None, docx_text(content) if kind == "docx" else content.decode("utf-8"), None
        except Exception as e:  # noqa: BLE001  whatever a file holds, it costs one row
            yield None, None, str(e) if type(e) is ValueError else type(e).__name__

    @staticmethod
    def words(content: bytes) -> dict[int, str]:
        """Texts of pages: words (page, line, text; JSON, one a line) joined by blanks, lines by line ends."""
        pages: dict[int, dict[int, list[str]]] = {}
        for line in content.decode("utf-8").splitlines():
            if line.strip():
                w = json.loads(line)
                pages.setdefault(int(w["page"]), {}).setdefault(int(w.get("line", 0)), []).append(str(w["text"]))
        return {p: "\n".join(" ".join(own) for _, own in sorted(lines.items())) for p, lines in pages.items()}


class DocumentSource(DataSource):
    """``spark.read.format("paperloom_documents").load(folder)``: rows (source, kind, bytes, page, text, error) of the files under
    a folder of any file system that Arrow reaches.

    Ask for fewer columns by ``schema()``: without text, page and error no file is opened. Option ``files``: files of a
    partition. Names that begin with a dot or underscore are passed over."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DocumentReader:
        return DocumentReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DocumentSource)
