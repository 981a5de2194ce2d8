import csv
import io
import random
import re
from datetime import datetime

from tidemark.operators import parsing

GOOD = ["0123456789abcdef", "2", "fedcba9876543210", "aaaaaaaaaaaaaaaa", "2022-02-28 23:59:59", "10.50", "3", "a note"]


def fields_of(record):
    """The fields by reading character by character, or None for a fault of quoting."""
    out, i = [], 0
    while True:
        if i < len(record) and record[i] == '"':
            text, i = "", i + 1
            while True:
                j = record.find('"', i)
                if j < 0:
                    return None
                text, i = text + record[i:j], j + 1
                if i < len(record) and record[i] == '"':
                    text, i = text + '"', i + 1
                    continue
                break
            if i < len(record) and record[i] != ",":
                return None
        else:
            j = record.find(",", i)
            text = record[i:] if j < 0 else record[i:j]
            if '"' in text:
                return None
            i += len(text)
        out.append(text)
        if i >= len(record):
            return out
        i += 1


def reason_of(record):
    if record is None:
        return "column_count"
    f = fields_of(record)
    if f is None:
        return "quoting"
    if len(f) != 8:
        return "column_count"
    v = [x.strip(" ") for x in f]
    ok = all(re.fullmatch("[0-9a-f]{16}", v[k]) for k in (0, 2, 3)) and re.fullmatch("[0-9]+", v[1]) and all(re.fullmatch(r"|[0-9]+(\.[0-9]{1,2})?", v[k]) for k in (5, 6))
    try:
        ok = ok and re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}", v[4]) and datetime.strptime(v[4], "%Y-%m-%d %H:%M:%S")
    except ValueError:
        ok = False
    return None if ok else "invalid_value"


def reasons(spark, records):
    df = spark.createDataFrame([(i, r, "x") for i, r in enumerate(records)], "line_id bigint, raw string, reason string")
    parsed = parsing.parse_records(df, "raw")
    return {r.line_id: r._reason for r in parsed.select("line_id", "_reason").collect()}


def line(**changes):
    names = ["order_id", "order_item_id", "product_id", "seller_id", "date", "price", "freight", "note"]
    return ",".join(changes.get(n, v) for n, v in zip(names, GOOD))


CASES = [
    line(), line(note=""), line(note='"a, b"'), line(note='"with ""quotes"" and\r\nbreaks"'), line(note="a\nb"), line(note='""'), line(note='""""'), line(note='"'), line(note='a"b'), line(note='"a"b'), line(note=' "a"'), line(note='"a" '),
    line(note='"open, never closed'), line(price=""), line(price="1."), line(price=".5"), line(price="1.234"), line(price="+1"), line(price="-1"), line(price="1,5"), line(price="٣"), line(price=" 10.5 "), line(price="\t1"), line(price="1\n"), line(price="00012"),
    line(date="2023-02-29 00:00:00"), line(date="2024-02-29 00:00:00"), line(date="2022-01-01 24:00:00"), line(date="2022-01-01 23:60:00"), line(date="2022-1-01 00:00:00"), line(date="2022-01-01T00:00:00"), line(date="0000-01-01 00:00:00"), line(date="2022-01-01 00:00:00\n"),
    line(order_id="0123456789ABCDEF"), line(order_id=' 0123456789abcdef'), line(order_id='"0123456789abcdef"'), line(order_id=""), line(order_item_id="1.0"), line(order_item_id="9" * 30), line() + ",", ",".join(GOOD[:7]), "", ",,,,,,,", None, '"', "\x01\x02", line(note="\x01,\x02"), line(note='"\x01,\x02b\x02a"'),
    line(note="x" * 200_000), line(note='"' + 'ab""' * 50_000 + '"'), "," * 30_000, '"' * 30_001, line(note="\x00"),
]


def test_reasons(spark):
    got = reasons(spark, CASES)
    wrong = [(str(r)[:80], got[i], reason_of(r)) for i, r in enumerate(CASES) if got[i] != reason_of(r)]
    assert not wrong


def test_random_records(spark):
    rng = random.Random(11)
    records = ["".join(rng.choice(['"', ",", "a", "\n", '""', ',"', '",', " "]) for _ in range(rng.randrange(12))) for _ in range(500)]
    records += [re.sub(r"[,a0]", lambda m: rng.choice([m[0]] * 12 + ['"', "", ","]), line(note='"x, ""y"""')) for _ in range(300)]
    got = reasons(spark, records)
    assert all(got[i] == reason_of(r) for i, r in enumerate(records))


def test_round_trip(spark):
    notes = ["plain", 'say "hi", now', "line\nbreak", "", " spaced ", "\x01\x02", "ünï"]
    records = []
    for n in notes:
        out = io.StringIO()
        csv.writer(out, lineterminator="").writerow([*GOOD[:7], n])
        records.append(out.getvalue())
    df = spark.createDataFrame([(i, r) for i, r in enumerate(records)], "line_id bigint, raw string")
    got = {r.line_id: r for r in parsing.typed_rows(parsing.parse_records(df, "raw"), ["line_id"]).collect()}
    assert [got[i].item_note for i in range(len(notes))] == notes
    assert got[0].price == 10.5 and got[0].freight_value == 3.0 and got[0].order_item_id == 2 and got[0].shipping_limit_date == datetime(2022, 2, 28, 23, 59, 59)


def test_empty_and_values_out_of_range(spark):
    df = spark.createDataFrame([(1, line(order_item_id="9" * 30, price=""))], "line_id bigint, raw string")
    row = parsing.typed_rows(parsing.parse_records(df, "raw"), ["line_id"]).first()
    assert row.order_item_id is None and row.price is None
    assert parsing.rejected(parsing.parse_records(df.limit(0), "raw"), ["line_id"]).count() == 0


def test_reader_agrees_with_reclassification(spark, monkeypatch):
    """What the reader takes has the same values when it is taken apart instead."""
    sound = [r for r in CASES if reason_of(r) is None]
    df = spark.createDataFrame(list(enumerate(sound)), "line_id bigint, raw string")
    rows = {r.line_id: r for r in parsing.typed_rows(parsing.parse_records(df, "raw"), ["line_id"]).collect()}
    monkeypatch.setattr(parsing, "READ_FIELDS", 0)
    assert rows == {r.line_id: r for r in parsing.typed_rows(parsing.parse_records(df, "raw"), ["line_id"]).collect()} and len(rows) == len(sound)


def test_rejected_records_keep_their_text(spark):
    df = spark.createDataFrame([(1, line(note='a"b'), "x"), (2, line(), "y")], "line_id bigint, raw string, reason string")
    assert [tuple(r) for r in parsing.rejected(parsing.parse_records(df, "raw"), ["line_id"], "raw").collect()] == [(1, "quoting", line(note='a"b'))]
