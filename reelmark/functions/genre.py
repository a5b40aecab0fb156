"""Genre codes: three-level hierarchy and its look-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The first-level code that says that the genre stands in the user codes, in the space numbered by the second level.
EXTENDED = 14

ARIB, CS = 0, 2
# Names of both levels as broadcasts number them, space by space; what is named last in a line is number 15.
NAMES = {
    ARIB: """\
ニュース／報道: 定時・総合 天気 特集・ドキュメント 政治・国会 経済・市況 海外・国際 解説 討論・会談 報道特番 ローカル・地域 交通 その他
スポーツ: スポーツニュース 野球 サッカー ゴルフ その他の球技 相撲・格闘技 オリンピック・国際大会 マラソン・陸上・水泳 モータースポーツ マリン・ウィンタースポーツ 競馬・公営競技 その他
情報／ワイドショー: 芸能・ワイドショー ファッション 暮らし・住まい 健康・医療 ショッピング・通販 グルメ・料理 イベント 番組紹介・お知らせ その他
ドラマ: 国内ドラマ 海外ドラマ 時代劇 その他
音楽: 国内ロック・ポップス 海外ロック・ポップス クラシック・オペラ ジャズ・フュージョン 歌謡曲・演歌 ライブ・コンサート ランキング・リクエスト カラオケ・のど自慢 民謡・邦楽 童謡・キッズ 民族音楽・ワールドミュージック その他
バラエティ: クイズ ゲーム トークバラエティ お笑い・コメディ 音楽バラエティ 旅バラエティ 料理バラエティ その他
映画: 洋画 邦画 アニメ その他
アニメ／特撮: 国内アニメ 海外アニメ 特撮 その他
ドキュメンタリー／教養: 社会・時事 歴史・紀行 自然・動物・環境 宇宙・科学・医学 カルチャー・伝統文化 文学・文芸 スポーツ ドキュメンタリー全般 インタビュー・討論 その他
劇場／公演: 現代劇・新劇 ミュージカル ダンス・バレエ 落語・演芸 歌舞伎・古典 その他
趣味／教育: 旅・釣り・アウトドア 園芸・ペット・手芸 音楽・美術・工芸 囲碁・将棋 麻雀・パチンコ 車・オートバイ コンピュータ・ＴＶゲーム 会話・語学 幼児・小学生 中学生・高校生 大学生・受験 生涯教育・資格 教育問題 その他
福祉: 高齢者 障害者 社会福祉 ボランティア 手話 文字（字幕） 音声解説 その他
""",
    CS: """\
スポーツ(CS): テニス バスケットボール ラグビー アメリカンフットボール ボクシング プロレス その他
洋画(CS): アクション SF／ファンタジー コメディー サスペンス／ミステリー 恋愛／ロマンス ホラー／スリラー ウエスタン ドラマ／社会派ドラマ アニメーション ドキュメンタリー アドベンチャー／冒険 ミュージカル／音楽映画 ホームドラマ その他
邦画(CS): アクション SF／ファンタジー お笑い／コメディー サスペンス／ミステリー 恋愛／ロマンス ホラー／スリラー 青春／学園／アイドル 任侠／時代劇 アニメーション ドキュメンタリー アドベンチャー／冒険 ミュージカル／音楽映画 ホームドラマ その他
アダルト(CS): アダルト その他
""",
}
#: The genre that stands beside all of its space.
OTHER = (ARIB, 15, 15, "その他", "その他")


def named() -> list[tuple[int, int, int, str, str]]:
    """(space, level1, level2, main_name, sub_name) of all known genres."""
    out = []
    for space, lines in NAMES.items():
        for level1, line in enumerate(lines.splitlines()):
            main, subs = line.split(": ")
            *first, last = subs.split(" ")
            out += [(space, level1, level2, main, sub) for level2, sub in [*enumerate(first), (15, last)]]
    return [*out, OTHER]


def dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(named(), "space int, level1 int, level2 int, main_name string, sub_name string")


def from_nibbles(level1: Column, level2: Column, user1: Column, user2: Column) -> Column:
    """(space, level1, level2) of broadcast nibbles."""
    extended = level1 == EXTENDED
    return F.struct(
        F.when(extended, level2 + 1).otherwise(0).alias("space"), F.when(extended, user1).otherwise(level1).alias("level1"), F.when(extended, user2).otherwise(level2).alias("level2")
    )


def includes(group: Column, item: Column) -> Column:
    """A genre with level2 -1 includes all of its first level; here the space counts."""
    return (group["space"] == item["space"]) & (group["level1"] == item["level1"]) & ((group["level2"] == -1) | (group["level2"] == item["level2"]))


def with_names(rows: DataFrame, dimension: DataFrame) -> DataFrame:
    """Adds label: names of both levels, or the space and codes where any level is unknown. dimension: space, level1, level2, main_name, sub_name."""
    named = rows.join(dimension, ["space", "level1", "level2"], "left")
    space = F.when(F.col("space") == 0, "ARIB").when(F.col("space") == 2, "CS").otherwise(F.concat(F.lit("事業者定義("), (F.col("space") - 1).cast("string"), F.lit(")")))
    codes = F.concat(F.lit("不明な"), space, F.lit("ジャンル("), F.col("level1").cast("string"), F.lit("-"), F.col("level2").cast("string"), F.lit(")"))
    return named.withColumn("label", F.coalesce(F.concat("main_name", F.lit(" - "), "sub_name"), codes))
