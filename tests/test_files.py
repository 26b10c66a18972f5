"""Result files that break half way are named with the reason."""

from __future__ import annotations

import os

from pairspan.session import fresh_path
from pairspan.sources import files


def test_half_broken_files_are_told(spark):
    path = fresh_path(spark, "half").removeprefix("file://")
    for name in ("good", "cut", "flipped"):
        spark.range(20_000).selectExpr("id", "uuid() AS text").coalesce(1).write.parquet(f"{path}/{name}")
    spark.range(3).selectExpr("cast(id AS string) AS value").coalesce(1).write.text(f"{path}/text")
    part = {n: next(f"{path}/{n}/{f}" for f in os.listdir(f"{path}/{n}") if f.startswith("part-")) for n in ("cut", "flipped", "good", "text")}
    with open(part["cut"], "rb+") as f:
        f.truncate(os.path.getsize(part["cut"]) - 10)
    with open(part["flipped"], "rb+") as f:  # the footer stays whole, a page in the middle doesn't
        f.seek(os.path.getsize(part["flipped"]) // 3)
        f.write(b"\xff" * 4000)
    for name in ("cut", "flipped"):
        crc = f"{os.path.dirname(part[name])}/.{os.path.basename(part[name])}.crc"
        if os.path.exists(crc):
            os.remove(crc)
    got = {r.file: r.reason for r in files.file_faults(spark, path).collect()}
    assert set(got) == {part["cut"], part["flipped"], part["text"]} and all(got.values())
    assert files.file_faults(spark, f"{path}/good").count() == 0
