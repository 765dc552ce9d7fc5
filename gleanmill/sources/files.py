"""Files that the engine reads and writes."""

from __future__ import annotations

import configparser
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip

#: A site template's keys and defaults.
SITE_DEFAULTS = {
    "TASK_TYPE": "新闻", "REQUEST_URL": "", "SEARCH_IN_SITE": "", "ENCODE_TYPE": "utf-8", "DUP_METHOD": "LINK", "PAGE_START": "1", "PAGE_INCREACE_CNT": "1", "PAGE_TOTAL_CNT": "50",
    "STOP_TURN_PAGE": "True", "TIMEOUT_SEC": "60", "FETCH_INTERVAL_SEC": "600", "FETCH_THREAD_NUM": "5", "POST_DATA": "", "REQUEST_HEADERS": "{}",
}
SITES = "site string, task_type string, request_url string, search_in_site string, encode_type string, dup_method string, page_start int, page_increase int, page_total int, stop_turn_page boolean, timeout_sec int, fetch_interval_sec int, fetch_thread_num int, post_data string, headers map<string,string>"


def read_keywords(spark: SparkSession, path: str) -> DataFrame:
    """keyword: the non-blank lines of a UTF-8 text file or folder, stripped."""
    return spark.read.text(path).select(strip(F.col("value")).alias("keyword")).where("keyword <> ''")


def list_files(spark: SparkSession, folder: str, pattern: str = "*.dat", recursive: bool = True) -> DataFrame:
    """path, length, modified of files by a glob pattern on their name."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive)
    return reader.load(folder).select("path", "length", F.col("modificationTime").alias("modified"))


def parse_site(name: str, text: str) -> tuple | None:
    """A site from its template; None without a usable REQUEST_URL. Headers are a JSON object; 'None' stands for nothing, and for a number that is none its default holds."""
    parser = configparser.RawConfigParser(strict=False)
    parser.optionxform = str
    parser.read_string(text)
    own = dict(parser["TEMPLATE"]) if parser.has_section("TEMPLATE") else {}
    get = lambda k: (v if (v := own.get(k, "").strip()) not in ("", "None") else SITE_DEFAULTS[k])
    if len(get("REQUEST_URL")) < 10:
        return None

    def number(k: str) -> int:
        try:
            return int(get(k))
        except ValueError:
            return int(SITE_DEFAULTS[k])

    try:
        headers = {str(k): str(v) for k, v in json.loads(get("REQUEST_HEADERS")).items()}
    except (ValueError, AttributeError):
        headers = {}
    return (
        name, get("TASK_TYPE"), get("REQUEST_URL"), get("SEARCH_IN_SITE"), get("ENCODE_TYPE"), get("DUP_METHOD").upper(), number("PAGE_START"), number("PAGE_INCREACE_CNT"), number("PAGE_TOTAL_CNT"),
        get("STOP_TURN_PAGE").lower() == "true", number("TIMEOUT_SEC") or 40, number("FETCH_INTERVAL_SEC"), number("FETCH_THREAD_NUM"), get("POST_DATA"), headers,
    )


def read_sites(spark: SparkSession, folder: str, pattern: str = "*.dat") -> DataFrame:
    """A row for each usable site template of a folder. Templates are small files, one for each site: they are read on the driver."""
    rows = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True).select(F.input_file_name().alias("path"), "value").collect()
    found = [parse_site(r["path"].rsplit("/", 1)[-1], r["value"]) for r in sorted(rows, key=lambda r: r["path"])]
    return spark.createDataFrame([x for x in found if x], SITES)


@dataclass(frozen=True)
class EngineConfig:
    """The engine's settings file."""

    keyword_file: str
    site_folder: str
    fetch_count: int = 50
    processes: int = 1
    stat_host: str = ""
    stat_port: int = 0

    @staticmethod
    def parse(text: str) -> EngineConfig:
        """From INI text, by option name whatever the section; a fetch count below 1 is an error."""
        parser = configparser.RawConfigParser(strict=False)
        parser.read_string(text)
        own = {k: v.strip() for s in parser.sections() for k, v in parser[s].items()}
        out = EngineConfig(own.get("keyword_file", ""), own.get("site_dir", ""), int(own.get("each_fetch_count", 50)), int(own.get("process_num", 1)), own.get("host", ""), int(own.get("port", 0)))
        if out.fetch_count < 1:
            raise ValueError("the fetch count must be positive")
        return out


def read_page_list(spark: SparkSession, path: str) -> DataFrame:
    """line_id, url of a tab-separated list; lines without a url are left out."""
    rows = spark.read.csv(path, sep="\t", schema="line_id string, url string")
    return rows.select(strip(F.col("line_id")).alias("line_id"), strip(F.col("url")).alias("url")).where("url <> ''")


#: What a fetcher hands over.
FETCHED = "fetch_id bigint, url string, body binary, headers string, fetch_ts timestamp"


def read_fetched(spark: SparkSession, folder: str, stream: bool = False, files_per_trigger: int = 64) -> DataFrame:
    """Fetched pages from Parquet files, at once or as a stream of new files; pages without a body are left out."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_trigger) if stream else spark.read
    return reader.schema(FETCHED).parquet(folder).where("body IS NOT NULL")


REPORT_COLUMNS = ("idx", "date", "source", "title", "summary", "link", "page_url")


def write_report(records: DataFrame, path: str) -> None:
    """Records as tab-separated files with a header; tabs and line breaks within fields become spaces. ``idx`` counts a page's records."""
    plain = [F.translate(F.coalesce(F.col(c).cast("string"), F.lit("")), "\t\r\n", "   ").alias(c) for c in REPORT_COLUMNS]
    records.select(*plain).write.csv(path, sep="\t", header=True, quote="", escape="", emptyValue="", nullValue="")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_report`` wrote."""
    return spark.read.csv(path, sep="\t", header=True, quote="", schema=", ".join(f"{c} string" for c in REPORT_COLUMNS)).na.fill("")


def write_messages(messages: DataFrame, path: str, mode: str = "append") -> None:
    """Messages as lines of JSON."""
    messages.select(F.col("tasks_json").alias("value")).write.mode(mode).text(path)
