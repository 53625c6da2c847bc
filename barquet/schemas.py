"""Explicit schemas of the records the engine reads and writes."""

from pyspark.sql import types as T

MARKETS = ("NASDAQ", "KOSPI")

BARS_AT_REST = T.StructType(
    [
        T.StructField("market", T.StringType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("currency", T.StringType()),
        T.StructField("ts", T.StringType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.LongType()),
        T.StructField("timeframe", T.StringType()),
    ]
)

XBRL_POINT = T.StructType(
    [
        T.StructField("start", T.StringType()),
        T.StructField("end", T.StringType()),
        T.StructField("filed", T.StringType()),
        T.StructField("val", T.DoubleType()),
        T.StructField("form", T.StringType()),
        T.StructField("fp", T.StringType()),
        T.StructField("fy", T.IntegerType()),
    ]
)

FILING_POINT = T.StructType(
    [
        T.StructField("period_end", T.StringType()),
        T.StructField("filed", T.StringType()),
        T.StructField("val", T.DoubleType()),
    ]
)

FUNDAMENTALS_FILE = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("ni_quarterly", T.ArrayType(FILING_POINT)),
        T.StructField("equity", T.ArrayType(FILING_POINT)),
        T.StructField("shares", T.ArrayType(FILING_POINT)),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)

NEWS_ITEM = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("published_at", T.TimestampType()),
        T.StructField("provider", T.StringType()),
    ]
)

EXPERIMENT = T.StructType(
    [
        T.StructField("experiment_id", T.StringType()),
        T.StructField("created_ts", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("strategy", T.StringType()),
        T.StructField("params", T.MapType(T.StringType(), T.StringType())),
        T.StructField("universe", T.ArrayType(T.StringType())),
        T.StructField("date_start", T.StringType()),
        T.StructField("date_end", T.StringType()),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("notes", T.StringType()),
    ]
)

TRACK_ROW = T.StructType(
    [
        T.StructField("as_of", T.StringType()),
        T.StructField("market", T.StringType()),
        T.StructField("equity", T.DoubleType()),
        T.StructField("fx", T.DoubleType()),
    ]
)

OVERSEAS_PAGE = T.StructType(
    [
        T.StructField("rt_cd", T.StringType()),
        T.StructField(
            "output2",
            T.ArrayType(
                T.StructType(
                    [T.StructField(n, T.StringType()) for n in ("xymd", "open", "high", "low", "clos", "tvol")]
                )
            ),
        ),
    ]
)

DOMESTIC_PAGE = T.StructType(
    [
        T.StructField("rt_cd", T.StringType()),
        T.StructField(
            "output2",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField(n, T.StringType())
                        for n in ("stck_bsop_date", "stck_oprc", "stck_hgpr", "stck_lwpr", "stck_clpr", "acml_vol")
                    ]
                )
            ),
        ),
    ]
)


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


OVERSEAS_FILLS = T.StructType(
    [
        T.StructField(
            "output", T.ArrayType(_strings("odno", "pdno", "sll_buy_dvsn_cd", "ft_ccld_qty", "ft_ccld_unpr3"))
        )
    ]
)

DOMESTIC_FILLS = T.StructType(
    [
        T.StructField(
            "output1",
            T.ArrayType(_strings("odno", "pdno", "sll_buy_dvsn_cd", "tot_ccld_qty", "avg_prvs", "tot_ccld_amt")),
        )
    ]
)

DOMESTIC_BALANCE = T.StructType(
    [
        T.StructField("output1", T.ArrayType(_strings("pdno", "hldg_qty", "prpr"))),
        T.StructField(
            "output2", T.ArrayType(_strings("prvs_rcdl_excc_amt", "nxdy_excc_amt", "dnca_tot_amt", "nass_amt"))
        ),
    ]
)

OVERSEAS_BALANCE = T.StructType(
    [
        T.StructField("output1", T.ArrayType(_strings("ovrs_pdno", "ovrs_cblc_qty", "now_pric2"))),
        T.StructField("output2", _strings("frcr_pchs_amt1")),
    ]
)

#: A company-concept body: units in the order they stand, each with its points. All fields are text, so that
#: one bad point does not spoil its list.
CONCEPT_BODY = T.StructType([
    T.StructField(
        "units",
        T.MapType(
            T.StringType(),
            T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("start", "end", "filed", "val", "fy", "form")])),
        ),
    )
])
