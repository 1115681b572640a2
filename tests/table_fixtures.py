"""Small published tables with known traps."""


def cells_of(spark, tables):
    rows = []
    for rid, records in tables.items():
        names = list(dict.fromkeys(k for r in records for k in r))
        for row_idx, record in enumerate(records):
            for col_idx, name in enumerate(names):
                rows.append((rid, row_idx, col_idx, name, record.get(name)))
    return spark.createDataFrame(rows, "rid string, row_idx long, col_idx int, col_name string, cell string")


def table_rows(spark, tables, incomplete=(), untrusted=()):
    return spark.createDataFrame(
        [(rid, None, rid not in incomplete, rid not in untrusted) for rid in tables],
        "rid string, title string, complete boolean, header_trusted boolean",
    )


ASYLUM = [
    {"UPEKOOTETA": "Αίγυπτος", "ARIThMOS AITEMATON": "7547"},
    {"UPEKOOTETA": "Συρία", "ARIThMOS AITEMATON": "40000"},
    {"UPEKOOTETA": "Αφγανιστάν", "ARIThMOS AITEMATON": "26011"},
    {"UPEKOOTETA": "Ιράκ", "ARIThMOS AITEMATON": "129"},
    {"UPEKOOTETA": "ΣΥΝΟΛΟ", "ARIThMOS AITEMATON": "73687"},
]
VACCINATION = [
    {"referencedate": f"2021-01-0{d}T00:00:00", "area": area, "areaid": str(aid), "daytotal": str(total),
     "daydiff": str(diff), "totalvaccinations": str(cumulative)}
    for d, area, aid, total, diff, cumulative in [
        (1, "ΑΤΤΙΚΗΣ", 7, 100, 5, 100), (1, "ΑΧΑΙΑΣ", 12, 40, -3, 40),
        (2, "ΑΤΤΙΚΗΣ", 7, 80, -20, 180), (2, "ΑΧΑΙΑΣ", 12, 30, -10, 70),
        (3, "ΑΤΤΙΚΗΣ", 7, 70, -10, 250), (3, "ΑΧΑΙΑΣ", 12, 20, -10, 90),
    ]
]
CUMULATIVE_ONLY = [{k: r[k] for k in ("referencedate", "area", "totalvaccinations")} for r in VACCINATION]
CUMULATIVE_NO_TIME = [{"area": "A1", "totalvaccinations": "10"}, {"area": "B2", "totalvaccinations": "20"}]
INDEX = [
    {"FREQ": "M", "ACTIVITY": act, "BASE_PER": "2015", "TIME_PERIOD": period, "OBS_VALUE": value}
    for period, act, value in [
        ("2010-01", "BTE36", "86,6"), ("2010-01", "BTE37", "90,1"), ("2010-02", "BTE36", "87,2"),
        ("2010-02", "BTE37", "91"), ("2010-03", "BTE36", "88"), ("2010-03", "BTE37", "92,5"),
    ]
]
DUPLICATE_PERIOD = [
    {"TIME_PERIOD": "2010-01", "OBS_VALUE": "1,5"}, {"TIME_PERIOD": "2010-01", "OBS_VALUE": "2,5"},
    {"TIME_PERIOD": "2010-02", "OBS_VALUE": "3,5"},
]
SPELLINGS = [
    {"Περιοχή": "ΑΤΤΙΚΗ", "Πλήθος": "10"}, {"Περιοχή": "Αττική", "Πλήθος": "5"}, {"Περιοχή": "ATTIKH", "Πλήθος": "3"},
]
TOP_N = [{"Χώρα": f"Χώρα {i:02d}", "Πλήθος": str(100 - i)} for i in range(40)]
PERCENT = [{"Νομός": "Αχαΐα", "Ποσοστό": "45,3%"}, {"Νομός": "Ηλεία", "Ποσοστό": "12,1%"}]
ALL_NULL = [{"Νομός": "Αχαΐα", "Πλήθος": None}, {"Νομός": "Ηλεία", "Πλήθος": ""}]
ROW_TOTALS = [
    {"label": f"L{i}", "men": str(10 + i), "women": str(20 + 2 * i), "both": str(30 + 3 * i)} for i in range(5)
]
TRUNCATED = [{"place": f"P{i // 10}", "amount": str(i + 3)} for i in range(40)]

TABLES = {
    "asylum": ASYLUM, "vaccination": VACCINATION, "cumulative_only": CUMULATIVE_ONLY,
    "cumulative_no_time": CUMULATIVE_NO_TIME, "index": INDEX, "duplicate_period": DUPLICATE_PERIOD,
    "spellings": SPELLINGS, "top_n": TOP_N, "percent": PERCENT, "all_null": ALL_NULL,
    "row_totals": ROW_TOTALS, "truncated": TRUNCATED,
}
