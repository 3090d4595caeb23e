"""Explicit schemas; nothing is inferred."""

from pyspark.sql import types as T

S, L, I, D, B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: A paper as stored; missing numbers are 0 and missing strings '' (null is not a value here).
PAPER = struct(
    id=L,
    title=S,
    abstract=S,
    authors=T.ArrayType(S),
    year=I,
    venue=S,
    field=S,
    topic=S,
    topic_id=S,
    doi=S,
    url=S,
    pdf_url=S,
    cited_by=L,
    excluded=B,
    seq=L,
)

#: A work as crawled.
_NAMED = struct(id=S, display_name=S)
WORK = struct(
    id=S,
    title=S,
    abstract_inverted_index=T.MapType(S, T.ArrayType(I)),
    authorships=T.ArrayType(struct(author=struct(display_name=S))),
    publication_year=I,
    primary_location=struct(landing_page_url=S, source=struct(display_name=S)),
    best_oa_location=struct(pdf_url=S),
    doi=S,
    cited_by_count=L,
    primary_topic=struct(id=S, display_name=S, subfield=_NAMED, field=_NAMED),
    is_retracted=B,
    language=S,
)

PENDING = struct(id=S, reason=S, ts=L)

#: A row of the vector index; ``row`` is its place after grouping by cluster.
INDEX = struct(
    id=L,
    row=L,
    cluster=I,
    scale=D,
    q=T.ArrayType(T.ByteType()),
    cited=L,
    field=S,
    venue=S,
    topic=I,
    year=I,
)
CENTROID = struct(cluster=I, c=T.ArrayType(D))
INTERACTION = struct(user_id=L, ts=T.TimestampType(), kind=S, paper_id=L)


def with_defaults(df, schema: T.StructType = PAPER):
    """``df`` with the columns of ``schema``, in order, missing or null values replaced by zero, '' or false."""
    from pyspark.sql import functions as F

    zero = {S: F.lit(""), L: F.lit(0), I: F.lit(0), D: F.lit(0.0), B: F.lit(False)}
    out = []
    for f in schema:
        own = F.col(f"`{f.name}`").cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        if isinstance(f.dataType, T.ArrayType):
            own = F.coalesce(own, F.array().cast(f.dataType))
        elif f.dataType in zero and f.name not in ("id", "seq"):
            own = F.coalesce(own, zero[f.dataType].cast(f.dataType))
        out.append(own.alias(f.name))
    return df.select(*out)
