"""What users call by name: tools over many keys at once, temporary views, and table functions for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from lumentrace.operators import propagation, rootcause, series, topology
from lumentrace.sources.storage import materialise


class Engine:
    """Holds the domain's tables; every tool takes a DataFrame of keys and returns a DataFrame."""

    def __init__(self, boards: DataFrame, hops: DataFrame, metrics: DataFrame, rules: DataFrame):
        self.boards, self.hops, self.metrics, self.rules = boards, hops, metrics, rules

    def query_topology(self, keys: DataFrame) -> DataFrame:
        return topology.query_topology(self.hops, keys.select("board"))

    def get_metrics(self, keys: DataFrame) -> DataFrame:
        return series.board_metrics(self.metrics.join(keys.select("board").distinct(), "board", "left_semi"))

    def get_top_boards(self, n: int) -> DataFrame:
        return series.top_boards(self.metrics, n)

    def trace_service_path(self, keys: DataFrame) -> DataFrame:
        return topology.trace_paths(self.hops.join(keys.select("path_id").distinct(), "path_id", "left_semi"))

    def lookup_rule(self, asked: DataFrame) -> DataFrame:
        return propagation.lookup_rule(self.rules, asked)

    def validate_propagation(self, hypotheses: DataFrame, max_hops: int = 4) -> DataFrame:
        """Summary of the flow from each hypothesis (root, board, alarm), all in one propagation."""
        typed = materialise(topology.typed_boards(self.boards, self.hops), "typed")
        targets = topology.nearest_of_type(self.hops, typed, sectioned=True)
        react = materialise(propagation.reactions(self.rules, typed, targets, topology.adjacency(self.hops)), "reactions")
        return propagation.flow_summary(propagation.propagate(hypotheses, react, max_hops, materialise))

    def search_similar(self, cases: DataFrame, asked: DataFrame, span: float = 8.0, top: int = 3) -> DataFrame:
        return rootcause.similar_cases(cases, asked, span, top)

    def call(self, tool: str, *args, **kwargs) -> DataFrame:
        """A tool by name; an unknown one is an error that names the known ones."""
        known = ("query_topology", "get_metrics", "get_top_boards", "trace_service_path", "lookup_rule", "validate_propagation", "search_similar")
        if tool not in known:
            raise ValueError(f"unknown tool {tool!r}; known: {', '.join(known)}")
        return getattr(self, tool)(*args, **kwargs)

    def register_views(self) -> None:
        for name in ("boards", "hops", "metrics", "rules"):
            getattr(self, name).createOrReplaceTempView(name)


class CsvTable:
    """Rows of a CSV block under its own header line, in the columns that the call's ``header`` names."""

    @staticmethod
    def analyze(block: AnalyzeArgument, header: AnalyzeArgument) -> AnalyzeResult:
        if not header.isConstantExpression or not isinstance(header.value, str):
            raise ValueError("csv_table needs its header as a constant text")
        schema = T.StructType().add("n", T.IntegerType())
        for name in dict.fromkeys(header.value.split(",")):
            schema = schema.add(name.strip(), T.StringType())
        return AnalyzeResult(schema)

    def eval(self, block: str, header: str):
        white = " \t\n\x0b\f\r"
        lines = [x for line in (block or "").split("\n") if (x := line.strip(white))]
        own = [h.strip(white) for h in lines[0].split(",")] if lines else []
        at = [own.index(h) if h in own else None for h in dict.fromkeys(h.strip() for h in header.split(","))]
        rows = [f for line in lines[1:] if len(f := line.split(",")) >= min(len(own), 6)]
        for n, f in enumerate(rows):
            yield (n, *[f[i].strip(white) if i is not None and i < len(f) else None for i in at])


def register_functions(spark: SparkSession) -> None:
    """SQL table functions: ``csv_table(block, header)``, whose columns follow the header, and ``chunk_text(text, size, overlap)``, in SQL itself."""
    spark.udtf.register("csv_table", udtf(CsvTable))
    spark.sql(r"""CREATE OR REPLACE TEMPORARY FUNCTION chunk_text(text STRING, size INT, overlap INT) RETURNS TABLE (chunk INT, part STRING)
RETURN SELECT chunk, part FROM (SELECT c.pos AS chunk, substring(chunk_text.text, c.col + 1, chunk_text.size) AS part
FROM (SELECT 1) LATERAL VIEW posexplode(sequence(0, greatest(length(chunk_text.text) - 1, 0), greatest(1, chunk_text.size - chunk_text.overlap))) c AS pos, col
WHERE length(chunk_text.text) > 0) WHERE part RLIKE '[^\\x20\\x09-\\x0D]'""")
