"""Profilers' binary files as Spark data sources: one file, one partition, since a file is a sequential stream. Files are read by Spark itself
(binaryFile), so that any file system that Spark knows will do; the decoders are plain functions on bytes."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from datetime import UTC, datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship

PACKET, FILLER = 17, 0x1A


def split_mrd(data: bytes) -> tuple[str, bytes]:
    """Header and packets. The header ends with the first filler byte that fills up a packet's length."""
    at = next((i for i in range(PACKET - 1, len(data), PACKET) if data[i] == FILLER), None)
    if at is None:
        raise ValueError("the header has no end")
    head, body = data[: at + 1].rstrip(bytes([FILLER])), data[at + 1 :]
    try:
        return head.decode("utf-8"), body
    except UnicodeDecodeError:
        return head.decode("cp1252", "replace"), body


def mrd_sensors(header: str) -> list[dict]:
    """Lines of twelve tokens: device number, device, channel, type of calibration, name, unit and six coefficients."""
    out = []
    for line in header.splitlines():
        t = line.split()
        if len(t) >= 12 and t[0].isdigit() and t[2].isdigit() and "MSS" in t[1]:
            out.append({"device": int(t[0]), "channel": int(t[2]), "calibration": t[3], "name": t[4], "unit": t[5], "coefficients": [float(x) for x in t[6:12]]})
    return out


def _minutes(word: int) -> int:
    return word & 0x1FFF


def mrd_samples(packets: bytes) -> tuple[np.ndarray, dict]:
    """(samples, 16) counts, and the first time and position. Types 7 and 8 hold channels 0-7 and 8-15; the longer of both is cut."""
    n = len(packets) // PACKET
    raw = np.frombuffer(packets[: n * PACKET], np.uint8).reshape(n, PACKET)
    words = raw[:, 1:].copy().view("<u2")
    low, high = words[raw[:, 0] == 7], words[raw[:, 0] == 8]
    m = min(len(low), len(high))
    about: dict = {}
    for kind, name in ((1, "time"), (3, "position")):
        if len(at := np.flatnonzero(raw[:, 0] == kind)[:1]):
            w = words[at[0]]
            about[name] = [int(w[i]) for i in (0, 1, 2, 4, 5, 6)] if kind == 1 else [mrd_coordinate(int(w[i]), int(w[i + 1])) for i in (0, 2)]
    return np.hstack([low[:m], high[:m]]).astype(np.int32), about


def mrd_coordinate(word: int, fraction: int) -> float:
    """Degrees and minutes in the low 13 bits, the minutes' decimals in a word of their own; without the sign bit it is negative."""
    whole = _minutes(word)
    minutes = whole % 100 + (fraction / 10 ** len(str(fraction)) if fraction else 0.0)
    return (whole // 100 + minutes / 60) * (1 if word & 0x8000 else -1)


def read_mrd(spark: SparkSession, path: str) -> DataFrame:
    """path, i, ch (16 counts), one row per sample."""
    ship(spark)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, data in zip(b["path"], b["content"], strict=True):
                ch, _ = mrd_samples(split_mrd(data)[1])
                yield pd.DataFrame({"path": p, "i": np.arange(len(ch), dtype=np.int64), "ch": list(ch)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, "path string, i bigint, ch array<int>")


def read_mrd_headers(spark: SparkSession, path: str) -> DataFrame:
    """path and a row per sensor."""
    ship(spark)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, data in zip(b["path"], b["content"], strict=True):
                rows = mrd_sensors(split_mrd(data)[0])
                yield pd.DataFrame([{"path": p} | r for r in rows], columns=["path", "device", "channel", "calibration", "name", "unit", "coefficients"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, "path string, device int, channel int, calibration string, name string, unit string, coefficients array<double>")


def mrd_about(data: bytes) -> dict:
    """A file's ship, cruise and PC time as its header writes them, and the first time and position of its packets."""
    head, packets = split_mrd(data)
    lines = head.splitlines()
    ship_name, cruise = re.search(r"Ship    :   (.{0,8})", head), re.search(r"Cruise: (.{0,17})", head)
    about = mrd_samples(packets)[1]
    when = "{:04d}-{:02d}-{:02d} {:02d}:{:02d}:{:02d}".format(*about["time"]) if "time" in about else None
    lat, lon = about.get("position", (None, None))
    return {
        "ship": ship_name[1].rstrip("_") if ship_name else None, "cruise": cruise[1].rstrip("_") if cruise else None, "date_pc": lines[2].strip() if len(lines) > 2 else None,
        "time": when, "latitude": lat, "longitude": lon,
    }


def read_mrd_about(spark: SparkSession, path: str) -> DataFrame:
    """A row per file: path, ship, cruise, date_pc, time, latitude, longitude."""
    ship(spark)
    names = ["path", "ship", "cruise", "date_pc", "time", "latitude", "longitude"]

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([{"path": p} | mrd_about(data) for p, data in zip(b["path"], b["content"], strict=True)], columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, "path string, ship string, cruise string, date_pc string, time string, latitude double, longitude double")


HEADER_WORDS = 64


def p_header(data: bytes) -> dict:
    """A record's header of 64 words; word 63 tells the order of bytes."""
    order = {0: "<", 1: "<", 256: "<", 2: ">", 512: ">"}.get(struct.unpack("<H", data[126:128])[0])
    if order is None:
        raise ValueError("unknown order of bytes")
    w = struct.unpack(f"{order}64H", data[:128])
    return {
        "order": order, "file": w[0], "record": w[1], "year": w[3], "month": w[4], "day": w[5], "hour": w[6], "minute": w[7], "second": w[8], "millisecond": w[9],
        "version": (w[10] >> 8) + (w[10] & 0xF) / 1000, "setup_bytes": w[11], "clock": w[20] + w[21] / 1000, "header_bytes": w[17], "record_bytes": w[18],
        "fast_columns": w[28], "slow_columns": w[29], "rows": w[30],
    }


def p_timestamp(head: dict) -> tuple[float, str, str]:
    """Seconds since 1970, date and time of a header, taken as UTC."""
    when = datetime(*(head[k] for k in ("year", "month", "day", "hour", "minute", "second")), head["millisecond"] * 1000, tzinfo=UTC)
    return when.timestamp(), when.strftime("%Y-%m-%d"), when.strftime("%H-%M-%S")


def parse_setup(text: str) -> dict[str, dict]:
    """Sections of key = value; ; starts a comment; [channel] sections are numbered, rows of [matrix] are lists of numbers."""
    out: dict[str, dict] = {"root": {}}
    at, channels = "root", 0
    for line in text.splitlines():
        line = line.split(";")[0].strip()
        if m := re.fullmatch(r"\[(.+)\]", line):
            at = m[1].strip().lower()
            if at == "channel":
                channels += 1
                at = f"channel{channels:02d}"
            out.setdefault(at, {})
        elif "=" in line:
            k, v = (x.strip() for x in line.split("=", 1))
            out[at][k.lower()] = [int(x) for x in v.split()] if at == "matrix" and k.lower().startswith("row") else _value(v)
    return out


def _value(v: str):
    for kind in (int, float):
        try:
            return kind(v)
        except ValueError:
            continue
    return v


def p_setup(data: bytes) -> dict[str, dict]:
    """The setup that the file carries behind its first header."""
    return parse_setup(data[128 : 128 + p_header(data)["setup_bytes"]].rstrip(b"\0").decode("utf-8", "replace"))


def p_records(data: bytes) -> tuple[dict, dict, np.ndarray]:
    """First header, setup and the data records as (records, words). Truncated files and missing records are refused."""
    head, setup = p_header(data), p_setup(data)
    start, size = 128 + head["setup_bytes"], head["record_bytes"]
    if (len(data) - start) % size:
        raise ValueError("the file is truncated")
    n = (len(data) - start) // size
    for k in range(n):
        if p_header(data[start + k * size :][:128])["record"] != k + 1:
            raise ValueError("records are missing")
    body = np.frombuffer(data[start:], np.uint8).reshape(n, size)[:, 128:]
    return head, setup, body.copy().view(">i2").astype(np.int32)


def p_channels(head: dict, setup: dict, records: np.ndarray) -> Iterator[tuple[str, int, bool, np.ndarray]]:
    """Name, id, whether it is fast, and samples in order. A channel in each row of the address matrix is fast; one that is there once is slow."""
    rows = [v for k, v in sorted(setup["matrix"].items()) if k.startswith("row")]
    address = np.array(rows).ravel()
    flat = records.reshape(-1, len(address))
    named = {int(c["id"]): str(c.get("name", c["id"])) for k, c in setup.items() if k.startswith("channel") and "id" in c}
    if 255 in address:
        named.setdefault(255, "ch255")
    for i, name in named.items():
        places = np.flatnonzero(address == i)
        if len(places) in (1, len(rows)):
            yield name, i, len(places) == len(rows) and len(rows) > 1, flat[:, places].ravel()


def read_p_setup(spark: SparkSession, path: str) -> DataFrame:
    """A row per file: path, timestamp (seconds since 1970), date, time, sampfreq (Hz, of fast channels), rows (fast samples to a slow one) and setup (JSON)."""
    ship(spark)
    names = ["path", "timestamp", "date", "time", "sampfreq", "rows", "setup"]

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, data in zip(b["path"], b["content"], strict=True):
                head, setup = p_header(data), p_setup(data)
                out.append([p, *p_timestamp(head), head["clock"] / (head["fast_columns"] + head["slow_columns"]), head["rows"], json.dumps(setup)])
            yield pd.DataFrame(out, columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, "path string, timestamp double, date string, time string, sampfreq double, rows int, setup string")


def read_p(spark: SparkSession, path: str) -> DataFrame:
    """path, channel, id, fast, i, time (s), value (counts)."""
    ship(spark)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, data in zip(b["path"], b["content"], strict=True):
                head, setup, records = p_records(data)
                columns, rows = head["fast_columns"] + head["slow_columns"], head["rows"]
                fs = head["clock"] / columns
                for name, i, fast, v in p_channels(head, setup, records):
                    at = np.arange(len(v))
                    yield pd.DataFrame({"path": p, "channel": name, "id": i, "fast": fast, "i": at, "time": at / (fs if fast else fs / rows), "value": v})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, "path string, channel string, id int, fast boolean, i bigint, time double, value int")
