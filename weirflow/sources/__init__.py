"""Connections, readers and writers."""

from __future__ import annotations

import io
import json
import math
import re
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from decimal import Decimal
from itertools import islice
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from weirflow.sources import statements
from weirflow.sources.log import TableLog

# Keywords of providers and connection strings, in the order in which they are tried.
CONNECTORS = [
    ("sap_hana", ("hana",)), ("sap_bw", ("sapbw", "sap bw", "saprfc")), ("salesforce", ("salesforce",)), ("oracle", ("oracle", "oraoledb", "msdaora")),
    ("teradata", ("teradata", "tdoledb")), ("db2", ("db2", "ibmda")), ("mysql", ("mysql",)), ("postgresql", ("postgres", "pgsql", "npgsql")),
    ("s3", ("s3://", "s3a://", "amazonaws")), ("gcs", ("gs://", "googleapis.com/storage")), ("bigquery", ("bigquery",)), ("rest", ("http://", "https://")),
    ("excel", ("microsoft.ace.oledb", "excel")), ("odbc", ("odbc", "dsn=")), ("ado_net", ("sqlclient", ".net")), ("oledb", ("sqlncli", "sqloledb", "msoledbsql", "oledb")),
]
READ_FORMATS = {"s3": "parquet", "gcs": "parquet", "excel": "excel", "rest": "json"}


def detect_connector(provider: str = "", connection_string: str = "") -> str:
    """The kind of a connection, by the first rule that its provider or string meets; OLE DB if none does."""
    text = f"{provider} {connection_string}".lower()
    return next((kind for kind, words in CONNECTORS if any(w in text for w in words)), "oledb")


@dataclass
class Connection:
    name: str
    id: str = ""
    kind: str = ""
    connection_string: str = ""
    provider: str = ""
    server: str = ""
    database: str = ""
    url: str = ""
    options: dict[str, str] = field(default_factory=dict)

    @property
    def connector(self) -> str:
        return self.kind or detect_connector(self.provider, self.connection_string)


@dataclass
class Registry:
    """Connections by id or name, and the tables that stand in for databases: a table name leads to a path, paths or a DataFrame."""

    spark: SparkSession
    connections: dict[str, Connection] = field(default_factory=dict)
    tables: dict[str, str | list[str] | DataFrame] = field(default_factory=dict)
    warehouse: str = ""
    procedures: dict[str, Callable] = field(default_factory=dict)
    #: Columns, by table, that number new rows.
    identities: dict[str, str] = field(default_factory=dict)
    log: TableLog | None = None
    version: int = 0
    entries: dict[str, dict] = field(default_factory=dict)
    held: bool = False

    def add(self, connection: Connection) -> None:
        for key in (connection.name, connection.id):
            if key:
                self.connections[key.lower()] = connection

    def connection(self, ref: str) -> Connection | None:
        """By id or name; also by the name inside a reference such as Package.ConnectionManagers[x]."""
        m = re.search(r"\[([^\]]+)\]", ref or "")
        return self.connections.get((ref or "").lower()) or self.connections.get(m[1].lower() if m else "")

    def table(self, name: str) -> DataFrame:
        found = self.tables.get(self.key(name))
        if found is None:
            return self.spark.table(clean_name(name))
        return found if isinstance(found, DataFrame) else self.spark.read.parquet(*([found] if isinstance(found, str) else found))

    @property
    def folder(self) -> str:
        """Where tables are written: ``warehouse``, else the session's own, which on a cluster has to be named."""
        own = self.spark.conf.get("spark.sql.warehouse.dir")
        if not self.warehouse and not self.spark.sparkContext.master.startswith("local") and self.spark.sparkContext.getConf().get("spark.sql.warehouse.dir") is None:
            raise ValueError("a registry on a cluster needs a warehouse that driver and executors share")
        return (self.warehouse or own).rstrip("/")

    def new_folder(self, name: str) -> str:
        return f"{self.folder}/{re.sub(r'[^0-9a-z_]', '_', clean_name(name))}-{uuid.uuid4().hex}"

    def put(self, name: str, rows: DataFrame) -> None:
        """Write a new version of a table in a folder of its own, then let the name point to it; readers of the old one go on."""
        path = self.new_folder(name)
        write_table(rows, path, "overwrite")
        self.tables[self.key(name)] = path
        self.commit()

    def attach(self, name: str, path: str) -> None:
        """Add the rows of a written folder to a table."""
        key = self.key(name)
        old = self.tables.get(key)
        if old is None or old == path:
            self.tables[key] = path
        elif isinstance(old, DataFrame):
            self.tables[key] = old.unionByName(self.spark.read.parquet(path), allowMissingColumns=True)
        else:
            self.tables[key] = list(dict.fromkeys([*([old] if isinstance(old, str) else old), path]))
        self.commit()

    def key(self, name: str) -> str:
        """The name under which a table is registered, with or without its schema; the name itself if it is not."""
        name = clean_name(name)
        if name in self.tables:
            return name
        schema, _, last = name.rpartition(".")
        near = [last] if schema else [k for k in self.tables if k.rpartition(".")[2] == last]
        return next((k for k in near if k in self.tables), name)

    def append(self, name: str, rows: DataFrame) -> str:
        """Add rows to a table as files of their own; their folder."""
        path = self.new_folder(name)
        write_table(rows, path, "overwrite")
        self.attach(name, path)
        return path

    def kept(self, rows: DataFrame) -> DataFrame:
        """Rows that are read more than once, written and read back."""
        path = self.new_folder("_kept")
        write_table(rows, path, "overwrite")
        return self.spark.read.schema(rows.schema).parquet(path)

    def procedure(self, name: str) -> Callable:
        """The function that EXEC calls; it gets the registry and its arguments and may return rows or output values by name."""
        found = self.procedures.get(clean_name(name).removeprefix("dbo."))
        if found is None:
            raise ValueError(f"needs a registered procedure: {name}")
        return found

    def register_procedure(self, name: str, fn: Callable) -> None:
        self.procedures[clean_name(name).removeprefix("dbo.")] = fn

    # ---- versions that outlast the session

    @classmethod
    def open(cls, spark: SparkSession, warehouse: str) -> Registry:
        """The tables of a warehouse as its newest version has them; every change from now on is a version."""
        out = cls(spark, warehouse=warehouse)
        out.log = TableLog(spark, warehouse)
        out.version, out.entries = out.log.read()
        for name, entry in out.entries.items():
            out.tables[name] = entry["folders"] if "folders" in entry else stream_rows(spark, entry)
        return out

    def commit(self) -> None:
        """Write the tables' folders as a version, unless a transaction is going on."""
        if self.log is None or self.held:
            return
        made = {}
        for name, found in self.tables.items():
            if not isinstance(found, DataFrame):
                made[name] = {"folders": [found] if isinstance(found, str) else found}
            elif name in self.entries:
                made[name] = self.entries[name]
        if made != self.entries:
            self.version = self.log.commit(self.version, made)
            self.entries = made

    @contextmanager
    def transaction(self):
        """Changes inside are one version, or none if something fails."""
        if self.held:
            yield
            return
        before, self.held = dict(self.tables), True
        try:
            yield
            self.held = False
            self.commit()
        except BaseException:
            self.tables.clear()
            self.tables.update(before)
            raise
        finally:
            self.held = False

    def sql(self, text: str, args: list | None = None) -> DataFrame:
        """Run a batch of statements as one transaction; the rows of its last query, or none.

        TRUNCATE, DELETE, UPDATE and MERGE make a new version of a registered table, INSERT adds files to it.
        """
        with self.transaction():
            return statements.run(self, text, args)


def stream_rows(spark: SparkSession, entry: dict) -> DataFrame:
    """The current rows of a table that a stream of changes keeps up to date."""
    schema = T.StructType.fromJson(entry["schema"])
    folders = [f for f in entry["buckets"].values() if f]
    rows = spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
    return rows.filter("NOT _deleted").select(*[F.col(f"`{c}`") for c in entry["columns"]])


def clean_name(name: str) -> str:
    return re.sub(r'[\[\]"`]', "", name).strip().lower()


def dialect(sql: str) -> str:
    """A T-SQL query in Spark's dialect; EXEC and DECLARE, which are no queries, raise."""
    return statements.dialect(Registry(None), sql)


def read_database(registry: Registry, connection: Connection | None, query: str | None = None, table: str | None = None) -> DataFrame:
    """A query wins over a table. Without a JDBC url the registered tables stand in for the database.

    With ``partitionColumn`` among a connection's options (a number, a date or a time, or ``auto`` for the first whole number)
    a database is read by ``numPartitions`` tasks, 8 by default. Bounds that are not given are asked for first; rows without a
    value are read by the first task.
    """
    if not query and not table:
        raise ValueError("a source needs a query or a table")
    if not (connection and connection.url):
        return registry.sql(query) if query else registry.table(table)
    options = dict(connection.options)
    column = options.pop("partitionColumn", None)
    reader = registry.spark.read.format("jdbc").option("url", connection.url).options(**options)
    # A query that is read in parts has to stand as a table.
    whole = f"({query}) part" if query else table
    if column == "auto":
        kinds = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
        column = next((f.name for f in reader.option("dbtable", whole).load().schema if isinstance(f.dataType, kinds)), None)
    if column and "lowerBound" not in options:
        quoted = registry.spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(connection.url).quoteIdentifier(column)
        asked = registry.spark.read.format("jdbc").option("url", connection.url).options(**{k: v for k, v in options.items() if k != "numPartitions"})
        low, high = asked.option("query", f"SELECT min({quoted}) AS low_end, max({quoted}) AS high_end FROM {whole}").load().first()
        if isinstance(low, (float, Decimal)):  # bounds of numbers are whole
            low, high = math.floor(low), math.ceil(high)
        options |= {} if low is None else {"lowerBound": str(low), "upperBound": str(high)}
        column = None if low is None else column
    if not column:
        return reader.option("query", query).load() if query else reader.option("dbtable", table).load()
    options.setdefault("numPartitions", 8)
    return reader.options(**options).option("partitionColumn", column).option("dbtable", whole).load()


def script_source(spark: SparkSession, name: str, schema: str | T.StructType, split: Callable[[], list], rows: Callable[[object], Iterator[tuple]]) -> DataFrame:
    """The rows of a source that a script has: ``split`` names its parts, and a task each calls ``rows`` with one of them."""
    kind = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    class Reader(DataSourceReader):
        def partitions(self):
            return [InputPartition(p) for p in split()]

        def read(self, partition):
            yield from rows(partition.value)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return f"script_{re.sub(r'[^0-9a-z]', '_', name.lower())}"

        def schema(self):
            return kind

        def reader(self, schema):
            return Reader()

    spark.dataSource.register(Source)
    return spark.read.format(Source.name()).load()


def read_flat(spark: SparkSession, path: str, schema: T.StructType | str | None = None, header: bool = True, delimiter: str = ",", quote: str = '"') -> DataFrame:
    reader = spark.read.option("header", header).option("sep", delimiter).option("quote", quote)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_xml(spark: SparkSession, path: str, row_tag: str = "row", schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.format("xml").option("rowTag", row_tag)
    return (reader.schema(schema) if schema else reader).load(path)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def change_table(name: str) -> str:
    """The change table of a table: cdc.<schema>_<table>_CT, unless it is one already."""
    key = clean_name(name)
    return key if key.startswith("cdc.") else f"cdc.{key.replace('.', '_')}_ct"


def read_cdc(registry: Registry, connection: Connection | None, table: str | None = None, query: str | None = None, low=None, high=None, lsn: str = "__$start_lsn") -> DataFrame:
    from weirflow.operators.dimensions import lsn_range

    rows = read_database(registry, connection, query, None if query else change_table(table or ""))
    return lsn_range(rows, f"`{lsn}`", low, high)


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def sheet_rows(data: bytes, sheet: str = "Sheet1") -> Iterator[list[str | None]]:
    """The cells of a workbook's sheet as texts, row by row from A1; a row is let go of when the next one is read."""
    tag = lambda name: f"{{{_NS['m']}}}{name}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for _, si in ElementTree.iterparse(z.open("xl/sharedStrings.xml")):
                if si.tag == tag("si"):
                    shared.append("".join(t.text or "" for t in si.iter(tag("t"))))
                    si.clear()
        names = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).findall("m:sheets/m:sheet", _NS)]
        k = names.index(sheet.rstrip("$")) + 1 if sheet.rstrip("$") in names else 1
        body = None
        for event, row in ElementTree.iterparse(z.open(f"xl/worksheets/sheet{k}.xml"), events=("start", "end")):
            if row.tag == tag("sheetData") and event == "start":
                body = row
            if row.tag != tag("row") or event == "start":
                continue
            cells: list[str | None] = []
            for c in row.findall("m:c", _NS):
                at = 0
                for ch in re.match(r"[A-Z]*", c.get("r", ""))[0]:
                    at = at * 26 + ord(ch) - 64
                at = at or len(cells) + 1
                cells += [None] * (at - len(cells))
                v = c.find("m:v", _NS)
                text = v.text if v is not None else "".join(t.text or "" for t in c.iter(tag("t"))) or None
                cells[at - 1] = shared[int(text)] if c.get("t") == "s" else text
            yield cells
            if body is not None:
                body.clear()


#: Rows of a sheet that are handed on at once.
SHEET_ROWS = 10_000


def read_excel(spark: SparkSession, path: str, schema: str, sheet: str = "Sheet1") -> DataFrame:
    """Workbooks with a header row; a task reads each as a stream of rows. Values are cast to the schema, null where they cannot be."""
    target = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    names = target.names

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for content in batch.column("content"):
                rows = sheet_rows(content.as_py(), sheet)
                head = next(rows, [])
                place = {name: k for k, name in enumerate(head)}
                while body := list(islice(rows, SHEET_ROWS)):
                    pick = [place.get(n) for n in names]
                    columns = [[None if k is None or k >= len(r) else r[k] for r in body] for k in pick]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names)

    texts = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, ", ".join(f"`{n}` string" for n in names))
    return texts.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in target])


def map_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rename columns to a destination's spelling where only case differs; others keep their names."""
    wanted = {c.lower(): c for c in columns}
    return df.select(*[F.col(f"`{c}`").alias(wanted.get(c.lower(), c)) for c in df.columns])


def write_database(df: DataFrame, connection: Connection, table: str, batch_size: int = 10_000, mode: str = "append") -> None:
    df.write.format("jdbc").option("url", connection.url).option("dbtable", table).option("batchsize", batch_size).options(**connection.options).mode(mode).save()


def write_flat(df: DataFrame, path: str, header: bool = True, delimiter: str = ",") -> None:
    df.write.mode("overwrite").option("header", header).option("sep", delimiter).csv(path)


def write_table(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).parquet(path)


def manifest(table: str, connection: str, schema: T.StructType) -> str:
    """A destination's description as JSON."""
    columns = []
    for f in schema:
        d = f.dataType
        number = isinstance(d, T.DecimalType)
        columns.append({"name": f.name, "dataType": d.simpleString(), "length": f.metadata.get("length", 0), "precision": d.precision if number else 0, "scale": d.scale if number else 0})
    return json.dumps({"table": table, "connectionRef": connection, "columns": columns})


def hadoop(spark: SparkSession, path: str):
    """A path as Hadoop has it, and the file system that it lies in: local disk, HDFS, an object store."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> list[str]:
    """Files of a folder that a pattern meets, in order; local ones as plain paths."""
    where, fs = hadoop(spark, f"{folder.rstrip('/')}/{pattern}")
    found = [s.getPath() for s in fs.globStatus(where) or [] if s.isFile()]
    return sorted(p.toUri().getPath() if p.toUri().getScheme() in (None, "file") else p.toString() for p in found)


def file_operation(spark: SparkSession, operation: str, source: str, target: str = "") -> None:
    """Copy, move, rename or delete files and folders, or make a folder, in any store that Spark reaches."""
    s, fs = hadoop(spark, source)
    if operation in ("copy", "copy_file", "copy_directory", "move", "move_file", "move_directory", "rename"):
        t, other = hadoop(spark, target)
        done = spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, s, other, t, not operation.startswith("copy"), spark.sparkContext._jsc.hadoopConfiguration())
    elif operation in ("delete", "delete_file", "delete_directory"):
        done = fs.delete(s, operation == "delete_directory")
    elif operation == "create_directory":
        done = fs.mkdirs(s)
    elif operation == "delete_content":
        done = all([fs.delete(x.getPath(), True) for x in fs.listStatus(s)])
    elif operation == "set_attributes":
        fs.setPermission(s, spark.sparkContext._jvm.org.apache.hadoop.fs.permission.FsPermission(target or "644"))
        done = True
    else:
        raise ValueError(f"unknown file operation {operation}")
    if not done:
        raise OSError(f"{operation} of {source} did not succeed")
