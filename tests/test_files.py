"""Text logs read in blocks; capture files split by bytes."""
import os

from flowlens.sources import files as FS


def _numbers(rows):
    return sorted((r.line_no, r.line) for r in rows)


def test_log_lines_are_numbered_across_blocks_and_files(spark, tmp):
    texts = {"a.log": "\n".join(f"line {i} " + "x" * (i % 50) for i in range(700)) + "\n", "b.log": "one\n\n\nfour",
             "c.log": "", "d.log": "\n\nlast\r\nafter\r\n"}
    for name, text in texts.items():
        with open(os.path.join(tmp, name), "w", newline="") as f:
            f.write(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        df = FS.read_attack_log_text(spark, tmp)
        blocks = spark.read.text(tmp).select("_metadata.file_block_start").distinct().count()
        got = _numbers(df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert blocks > 5
    want, place = [], 0
    for name in sorted(texts):
        lines = texts[name].replace("\r\n", "\n").split("\n")
        lines = lines[:-1] if lines[-1] == "" else lines
        want += [(place * (1 << 32) + i + 1, x) for i, x in enumerate(lines)]
        place += bool(lines)
    assert got == want
