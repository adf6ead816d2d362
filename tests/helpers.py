"""Small frames for tests."""

DAY = 86_400_000
START = 1_577_836_800_000  # 2020-01-01


def bars(spark, closes, symbol="A", start=START, step=DAY, timeframe="1d", **columns):
    rows = []
    for i, c in enumerate(None if x is None else float(x) for x in closes):
        row = {"symbol": symbol, "timeframe": timeframe, "open_time": start + i * step, "year": 2020, "close": c}
        row |= {k: v[i] for k, v in columns.items()}
        rows.append(row)
    names = ["open", "high", "low", "volume"]
    for row in rows:
        for n in names:
            row.setdefault(n, row["close"])
    return spark.createDataFrame(rows, "symbol string, timeframe string, open_time long, year int, close double, "
                                 "open double, high double, low double, volume double")


def column(df, name, order="open_time"):
    return [r[name] for r in df.orderBy(order).collect()]
