"""Source files derived from the test tables.

The tables hold no source code, so code is spliced around their text. The SQL runs
unchanged in Spark and in other engines, which lets results be compared.

``document_files`` turns every document, whole, into a file: one row in, one row out.
``event_files`` makes files of 64 consecutive events each. The event id is the key, so
a file never has more lines than that, whatever users or types dominate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

EVENT_LINES = """
SELECT project_path, path, event_id, chunk,
       CASE WHEN ext = '.cs' THEN
         CASE m
           WHEN 0 THEN 'using Datadog.Unity;'
           WHEN 1 THEN 'using Datadog.Unity.Rum;'
           WHEN 2 THEN 'using Datadog.Unity.Logs;'
           WHEN 3 THEN concat('DatadogSdk.Instance.Rum.StartAction(RumUserActionType.Tap, "', event_type, '");')
           WHEN 4 THEN concat('DatadogSdk.Instance.Rum.AddError("', event_type, '");')
           WHEN 5 THEN concat('sdk.Rum.AddTiming("', event_type, '");')
           WHEN 6 THEN concat('DatadogSdk.Instance.Rum.StartView("', event_type, '");')
           WHEN 7 THEN concat('DatadogSdk.Instance.Rum.AddAttribute("k', CAST(event_id AS STRING), '", ', CAST(user_id AS STRING), ');')
           WHEN 8 THEN 'var logger = DatadogSdk.Instance.CreateLogger(opts);'
           WHEN 9 THEN concat('logger.Log(DdLogLevel.Warn, "', event_type, '");')
           WHEN 10 THEN concat('    logger.Info("', event_type, '");')
           WHEN 11 THEN 'logger.Error("failed"); logger.Info("x");'
           WHEN 12 THEN concat('DatadogSdk.Instance.SetUserInfo("', CAST(user_id AS STRING), '", name);')
           WHEN 13 THEN concat('sdk.AddLogsAttributes(attrs', CAST(user_id AS STRING), ');')
           WHEN 16 THEN 'DatadogSdk.InitWithPlatform(platform, config);'
           WHEN 17 THEN 'DatadogSdk.Instance.SetTrackingConsent(TrackingConsent.Granted);'
           WHEN 18 THEN 'DatadogSdk.Instance.SetSdkVerbosity(CoreLoggerLevel.Debug);'
           WHEN 19 THEN concat('DatadogSdk.Instance.Rum.StopAction(RumUserActionType.Scroll, "', event_type, '");')
           WHEN 20 THEN concat('view.Rum.StopAction("', event_type, '");')
           WHEN 21 THEN concat('DatadogSdk.Instance.Rum.AddTiming("', event_type, '");')
           WHEN 22 THEN 'DatadogSdk.Instance.Rum.StopView("v");'
           WHEN 23 THEN 'DatadogSdk.Instance.Rum.RemoveAttribute("k");'
           WHEN 24 THEN concat('logger.Log(DdLogLevel.Info, "', event_type, '");')
           WHEN 25 THEN 'logger.Log( DdLogLevel.Error, "bad");'
           WHEN 26 THEN 'logger.Warn("w"); logger.Debug("d");'
           WHEN 27 THEN concat('DatadogSdk.Instance.AddUserExtraInfo(extra', CAST(user_id AS STRING), ');')
           WHEN 28 THEN 'sdk.AddUserExtraInfo(more);'
           WHEN 29 THEN concat('DatadogSdk.Instance.AddLogsAttribute("a", ', CAST(user_id AS STRING), ');')
           WHEN 30 THEN CASE user_id % 3
             WHEN 0 THEN 'DatadogSdk.Instance.AddLogsAttributes(all);'
             WHEN 1 THEN 'DatadogSdk.Instance.RemoveLogsAttribute("a");'
             ELSE 'sdk.RemoveLogsAttribute("x");' END
           WHEN 31 THEN CASE user_id % 4
             WHEN 0 THEN 'using Datadog.Unity.Core;'
             WHEN 1 THEN 'public DdLogger log;'
             WHEN 2 THEN 'level = DdLogLevel other;'
             ELSE 'DdLogger log;' END
           WHEN 14 THEN CASE user_id % 3
             WHEN 0 THEN 'var t = RumUserActionType.Swipe;'
             WHEN 1 THEN concat('private DdLogger log', CAST(user_id AS STRING), ' = make(Rum.Of(1));')
             ELSE 'if (IDdRum.StopTiming (t)) return;' END
           ELSE 'DatadogSdk.Instance.ClearAllData();' END
       ELSE
         CASE m
           WHEN 0 THEN concat('import { datadogRum } from ', chr(39), '@datadog/browser-rum', chr(39), ';')
           WHEN 1 THEN concat('import { datadogLogs, logger as log } from ', chr(39), '@datadog/browser-logs', chr(39), ';')
           WHEN 2 THEN 'import reactPlugin from "@datadog/mobile-react-native";'
           WHEN 3 THEN concat('datadogRum.addAction("', event_type, '-btn", ', props, ');')
           WHEN 4 THEN concat('DD_RUM.addError(new Error("', event_type, '"));')
           WHEN 5 THEN concat('datadogRum.addTiming("', event_type, '", ', CAST(event_id AS STRING), ');')
           WHEN 6 THEN concat('  logger.info("user ', CAST(user_id AS STRING), '");')
           WHEN 7 THEN concat('datadogLogs.logger.error("', event_type, '", e); datadogRum.addError(e);')
           WHEN 8 THEN concat('logger.warn("', event_type, '")')
           WHEN 9 THEN concat('Logger.Debug("', event_type, '")')
           WHEN 10 THEN concat('datadogRum.init({ applicationId: "a', CAST(event_id AS STRING), '", clientToken: "tok', CAST(event_id AS STRING), 'abcdef", site: "eu" });')
           WHEN 11 THEN concat('x = datadogRum.setUser(f(', CAST(user_id AS STRING), '));')
           WHEN 16 THEN 'const r = require("@datadog/browser-rum");'
           WHEN 17 THEN concat('const l = require(', chr(39), '@datadog/browser-logs', chr(39), ');')
           WHEN 18 THEN 'import { reactPlugin } from "@datadog/browser-rum-react";'
           WHEN 19 THEN 'DD_RUM.init({ site: "us" });'
           WHEN 20 THEN concat('const log = datadogLogs.createLogger("', event_type, '");')
           WHEN 21 THEN concat('DD_RUM.addAction("', event_type, ' click");')
           WHEN 22 THEN concat('DD_RUM.addTiming("', event_type, '");')
           WHEN 23 THEN concat('datadogLogs.logger.info("', event_type, '", { n: ', CAST(event_id AS STRING), ' });')
           WHEN 24 THEN 'datadogLogs.logger.warn("w");'
           WHEN 25 THEN 'datadogLogs.logger.debug("d");'
           WHEN 26 THEN concat('logger.info("it', chr(39), 's', chr(9), event_type, '");')
           WHEN 27 THEN 'import trackError from "@datadog/error-kit";'
           WHEN 28 THEN concat('trackError(', CAST(user_id AS STRING), ');')
           WHEN 29 THEN CASE user_id % 2
             WHEN 0 THEN 'import clickAction from "@datadog/browser-rum-x";'
             ELSE 'import pageTiming from "@datadog/perf";' END
           WHEN 30 THEN CASE user_id % 2
             WHEN 0 THEN 'clickAction("a");'
             ELSE 'pageTiming.now(clickAction(1));' END
           WHEN 31 THEN 'const a = 1;'
           WHEN 12 THEN CASE user_id % 3
             WHEN 0 THEN 'plugins = [reactPlugin({ router: true })];'
             WHEN 1 THEN concat('a.b', CAST(user_id AS STRING), '.reactPlugin (new DatadogRum(), datadogRum)')
             ELSE '  return new reactPlugin' END
           WHEN 13 THEN CASE user_id % 2
             WHEN 0 THEN 'const a = b + c;'
             ELSE concat('import * as dd', CAST(user_id % 5 AS STRING), ' from "@datadog/browser-core";') END
           WHEN 14 THEN 'datadogRum : value'
           ELSE 'logger.info("")' END
       END AS line
FROM (
  SELECT *, concat('/repos/p', CAST(chunk % 7 AS STRING)) AS project_path,
         concat('/repos/p', CAST(chunk % 7 AS STRING),
                CASE WHEN ext = '.min.js' THEN '/dist/f' WHEN ext = '.cs' THEN '/Assets/F' ELSE '/src/f' END,
                CAST(chunk AS STRING), CASE WHEN chunk % 11 = 5 THEN upper(ext) ELSE ext END) AS path
  FROM (
    SELECT event_id, user_id, event_type, props, (event_id + user_id) % 32 AS m,
           CAST(floor(event_id / 64) AS BIGINT) AS chunk,
           CASE CAST(floor(event_id / 64) AS BIGINT) % 6 WHEN 0 THEN '.cs' WHEN 3 THEN '.cs' WHEN 1 THEN '.ts'
             WHEN 2 THEN '.tsx' WHEN 4 THEN '.js' ELSE '.min.js' END AS ext
    FROM events) numbered) placed
"""

# (first line, start of a text line, separator after a sentence, extension) per document kind
_WEB_HEAD = ("'import { datadogRum } from ', chr(39), '@datadog/browser-rum', chr(39), ';', chr(10), "
             "'import { datadogLogs } from ', chr(39), '@datadog/browser-logs', chr(39), ';', chr(10)")


def _spliced(head: str, line: str, sentence: str) -> str:
    return (f"concat({head}, '{line}', replace(replace(text, chr(10), concat('\");', chr(10), '{line}')), '. ', "
            f"concat('.\");', chr(10), '{sentence}')), '\");', chr(10))")


DOCUMENT_FILES = f"""
SELECT concat('/repos/', source) AS project_path,
       concat('/repos/', source, CASE doc_id % 8 WHEN 5 THEN '/dist/' WHEN 0 THEN '/Assets/' ELSE '/src/' END,
              lang, '/d', CAST(doc_id AS STRING),
              CASE doc_id % 8 WHEN 0 THEN '.cs' WHEN 1 THEN '.ts' WHEN 2 THEN '.tsx' WHEN 3 THEN '.js'
                WHEN 4 THEN '.jsx' WHEN 5 THEN '.min.js' WHEN 6 THEN '.cs' ELSE '.md' END) AS path,
       CASE doc_id % 8
         WHEN 0 THEN {_spliced("'using Datadog.Unity;', chr(10), 'using Datadog.Unity.Logs;', chr(10)",
                               'logger.Info("',
                               'DatadogSdk.Instance.Rum.StartAction(RumUserActionType.Tap, "')}
         WHEN 1 THEN {_spliced(_WEB_HEAD, 'logger.info("', '  datadogRum.addAction("')}
         WHEN 2 THEN {_spliced(_WEB_HEAD, 'DD_RUM.addError("', 'datadogRum.addTiming("')}
         WHEN 3 THEN {_spliced(_WEB_HEAD, 'logger.warn("', 'datadogLogs.logger.error("')}
         WHEN 5 THEN {_spliced(_WEB_HEAD, 'logger.info("', 'datadogRum.addAction("')}
         WHEN 6 THEN {_spliced("'using Datadog.Unity;', chr(10)",
                               'sdk.Rum.AddAttribute("k", "', 'logger.Log(DdLogLevel.Debug, "')}
         ELSE text END AS content
FROM documents
"""

EVENT_FILES = f"""
SELECT min(project_path) AS project_path, min(path) AS path, $JOINED AS content
FROM ({EVENT_LINES}) code GROUP BY chunk
"""
SPARK_JOINED = "listagg(line, chr(10)) WITHIN GROUP (ORDER BY event_id)"
DUCKDB_JOINED = "string_agg(line, chr(10) ORDER BY event_id)"

# Directories: every customer has one, holding what its number says.
LISTING_ENTRIES = """
SELECT concat('/homes/n', CAST(c_nationkey AS STRING)) AS root,
       concat('/homes/n', CAST(c_nationkey AS STRING), '/', CASE c_custkey % 13 WHEN 12 THEN '.h' ELSE 'c' END,
              CAST(c_custkey AS STRING)) AS dir, c_custkey AS k
FROM customer
"""
LISTING = f"""
SELECT root, concat(dir, '/', CASE k % 10 WHEN 0 THEN 'package.json' WHEN 1 THEN 'package.json'
         WHEN 2 THEN 'package.json' WHEN 3 THEN 'package.json' WHEN 4 THEN 'Assets/Main.cs' WHEN 5 THEN 'App.csproj'
         WHEN 6 THEN 'src/app.ts' WHEN 7 THEN 'README.md' WHEN 8 THEN 'lib/src/app.ts' ELSE 'tsconfig.json' END) AS path,
       (1 = 0) AS is_dir
FROM ({LISTING_ENTRIES}) a
UNION ALL
SELECT root, concat(dir, '/', CASE k % 3 WHEN 0 THEN 'ProjectSettings' WHEN 1 THEN 'docs' ELSE 'empty' END) AS path,
       (1 = 1) AS is_dir
FROM ({LISTING_ENTRIES}) b
UNION ALL
SELECT concat('/work/s', CAST(s_suppkey AS STRING)) AS root,
       concat('/work/s', CAST(s_suppkey AS STRING), CASE s_suppkey % 4 WHEN 0 THEN '/src/main.ts' WHEN 1 THEN '/tool.csproj'
         WHEN 2 THEN '/child/package.json' ELSE '/notes.txt' END) AS path, (1 = 0) AS is_dir
FROM supplier
"""
MANIFESTS = f"""
SELECT dir AS project_path,
       CASE k % 10 WHEN 0 THEN '{{"dependencies": {{"react": "^18.0.0", "next": "^13"}}}}'
         WHEN 1 THEN '{{"dependencies": {{"express": "4"}}, "devDependencies": {{"react": "18"}}}}'
         WHEN 2 THEN '{{"name": "plain", "dependencies": {{"reactive": "1"}}}}'
         ELSE CASE k % 3 WHEN 0 THEN 'not json' WHEN 1 THEN concat('{{', chr(39), 'dependencies', chr(39), ': {{', chr(39), 'react', chr(39), ': 1}}}}')
           ELSE '{{"dependencies": {{"react": "1"}}}} trailing' END END AS content
FROM ({LISTING_ENTRIES}) a WHERE k % 10 < 4
"""
REPO_META = """
SELECT concat('/homes/n', CAST(c_nationkey AS STRING), '/c', CAST(c_custkey AS STRING)) AS project_path,
       CASE c_custkey % 4 WHEN 0 THEN concat('feature-', lower(c_mktsegment)) WHEN 1 THEN '  ' WHEN 2 THEN ''
         ELSE NULL END AS current_branch,
       CASE c_custkey % 3 WHEN 0 THEN 'refs/remotes/origin/develop' WHEN 1 THEN NULL ELSE '' END AS origin_head,
       CASE c_custkey % 5 WHEN 0 THEN NULL ELSE concat(' https://github.com/example/', c_name, ' ') END AS remote_url,
       CASE c_custkey % 6 WHEN 0 THEN NULL ELSE concat('abc', CAST(c_custkey * 1000003 AS STRING), 'fedcba9876') END AS commit_hash
FROM customer
"""
# Branches of the projects of the file corpora, from the tables those projects come from.
CORPUS_REPOS = """
SELECT project_path, CASE WHEN n % 3 = 0 THEN NULL ELSE concat('b', CAST(n % 5 AS STRING)) END AS current_branch,
       CASE WHEN n % 2 = 0 THEN 'refs/remotes/origin/trunk' END AS origin_head,
       CAST(NULL AS STRING) AS remote_url, CAST(NULL AS STRING) AS commit_hash
FROM (SELECT concat('/repos/', source) AS project_path, count(*) AS n FROM documents GROUP BY source
      UNION ALL
      SELECT concat('/repos/p', CAST(k AS STRING)) AS project_path, count(*) AS n
      FROM (SELECT CAST(floor(event_id / 64) AS BIGINT) % 7 AS k FROM events) e GROUP BY k) counted
"""

# Kinds of encoded documents: (charset, a comment that every text of the kind starts with, letters and what stands for them:
# letters about as frequent in the charset's language).
ENCODED = (
    ("UTF-16LE", "", "", ""), ("UTF-16BE", "", "", ""), ("UTF-32BE", "", "", ""),
    ("windows-1252", "/* l’été où “tout” a été créé */", "", ""),
    ("windows-1250", "/* zażółć gęślą jaźń */", "lz", "łż"),
    ("windows-1254", "/* şifre yanlış, lütfen yeniden deneyiniz */", "gs", "ğş"),
    ("windows-1251", "/* ошибка подключения к серверу */", "etaoinshrdlucmwfgypbvkjxqz", "оеаинтсрвлкмдпуяыьгзбчйхжш"),
    ("KOI8-R", "/* ошибка подключения к серверу */", "etaoinshrdlucmwfgypbvkjxqz", "оеаинтсрвлкмдпуяыьгзбчйхжш"),
    ("windows-1253", "/* σφάλμα σύνδεσης με τον διακομιστή */", "etaoinshrdlucmwfgypbvkjxqz", "αοιετσνηυρπκμλωδγχθφβξζψςή"),
    ("windows-31j", "/* サーバーへの接続中にエラーが発生しました */", "aeioutnsrlcdkmpvgzbhyfjqwx", "のにはをたがでてとしれさいるなかもらこうすりくンスル"),
    ("EUC-JP", "/* サーバーへの接続中にエラーが発生しました */", "aeioutnsrlcdkmpvgzbhyfjqwx", "のにはをたがでてとしれさいるなかもらこうすりくンスル"),
    ("GB18030", "/* 连接服务器时发生错误，请稍后重试 */", "aeioutnsrlcdkmpvgzbhyfjqwx", "的一是不了在人有我他这个们中来上大为和国地到以说时要"),
    ("Big5", "/* 連接伺服器時發生錯誤，請稍後再試 */", "aeioutnsrlcdkmpvgzbhyfjqwx", "的一是不了在人有我他這個們中來上大為和國地到以說時要"),
    ("x-windows-949", "/* 서버에 연결하는 동안 오류가 발생했습니다 */", "aeioutnsrlcdkmpvgzbhyfjqwx", "이다의는에을가한고로를은하지도기사서인어리나시대자스"),
)


#: Bytes of a table's files that make one task of files, about: documents are whole files, an event a line of one.
DOCUMENT_BYTES, EVENT_BYTES = 16 << 20, 1 << 20
# A small table makes as many tasks as can run at once, none of less than this share of the bytes above.
LEAST_SHARE = 64


def tasks_of(spark: SparkSession, path: str, size: int) -> int:
    """How many tasks a table's files make that take ``size`` bytes of them each, about."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    held = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(place).getLength()
    return max(1, -(-held // size), min(spark.sparkContext.defaultParallelism, held * LEAST_SHARE // size))


def views(spark: SparkSession, sf_dir: str, names, dealt: bool = True) -> None:
    """The tables as views; documents, which files are made of, are ``dealt`` by rows to tasks of a bounded size.

    One file of the table is no single task then, and a task's share does not grow with the table.
    """
    for name in names:
        path = f"{sf_dir}/{name}.parquet"
        rows = spark.read.parquet(path)
        if dealt and name == "documents":
            rows = rows.repartition(tasks_of(spark, path, DOCUMENT_BYTES))
        elif name == "events":  # lines are made of them: a hint, so that one file of the table is no single task
            rows = rows.hint("rebalance")
        rows.createOrReplaceTempView(name)


def table(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Runs ``sql`` over the test tables it names."""
    views(spark, sf_dir, [t for t in TABLES if f"FROM {t}" in sql], dealt="text" in sql)
    return spark.sql(sql)


def event_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, EVENT_LINES)
    # paths are aggregates, not keys, so that filters on them see files, not lines
    made = lines.groupBy("chunk").agg(
        F.min("project_path").alias("project_path"), F.min("path").alias("path"),
        F.expr(SPARK_JOINED).alias("content")).drop("chunk")
    # little text is packed into few bytes, by which tasks are put together: files are dealt once more
    return made.repartition(tasks_of(spark, f"{sf_dir}/events.parquet", EVENT_BYTES))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, DOCUMENT_FILES)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both corpora: ``project_path, path, content``."""
    return event_files(spark, sf_dir).unionByName(document_files(spark, sf_dir))
