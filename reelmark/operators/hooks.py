"""What scripts that are called around a job may do to it: commands in their order, each allowed in some phases only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmark.functions.names import base_name
from reelmark.operators.catalogue import add_if_absent

ON_ADD, PRE_ENCODE, POST_ENCODE = "OnAdd", "PreEncode", "PostEncode"
ADD_TAG, SET_OUT_DIR, SET_PRIORITY, GET_OUT_FILES, CANCEL = "AddTag", "SetOutDir", "SetPriority", "GetOutFiles", "CancelItem"
# What a script is told.
DONE = "成功"
NO_DIR_AFTER = "エンコードが完了したアイテムの出力先は変更できません"
NO_DIR = "出力先を指定してください"
ONLY_ON_ADD = "追加時以外の優先度操作はできません"
OUT_OF_RANGE = "優先度が範囲外です"
NOT_ENCODED = "実行後ではないため、出力ファイルを取得できません"
NO_CANCEL = "エンコードが完了したアイテムはキャンセルできません"


def _taken(job: Column, c: Column) -> Column:
    """The job after a command, and the reply at the end of its replies. job: tags, dst_path, priority, state, out_files, replies."""
    name, arg, phase = c["command"], c["arg"], c["phase"]
    given = F.coalesce(arg, F.lit("")) != ""
    number = arg.try_cast("int")
    tags = F.when((name == ADD_TAG) & given, add_if_absent(job["tags"], arg)).otherwise(job["tags"])
    moves = (name == SET_OUT_DIR) & (phase != POST_ENCODE) & given
    path = F.when(moves, F.concat(F.regexp_replace(arg, r"\\+$", ""), F.lit("\\"), base_name(job["dst_path"]))).otherwise(job["dst_path"])
    ranked = (name == SET_PRIORITY) & (phase == ON_ADD) & F.coalesce(number.between(1, 5), F.lit(False))
    canceled = (name == CANCEL) & (phase != POST_ENCODE)
    reply = (
        F.when(name == ADD_TAG, F.array_join(tags, ";"))
        .when(name == SET_OUT_DIR, F.when(phase == POST_ENCODE, NO_DIR_AFTER).when(~given, NO_DIR).otherwise(DONE))
        .when(name == SET_PRIORITY, F.when(phase != ON_ADD, ONLY_ON_ADD).when(~ranked, OUT_OF_RANGE).otherwise(DONE))
        .when(name == GET_OUT_FILES, F.when(phase != POST_ENCODE, NOT_ENCODED).otherwise(F.array_join(job["out_files"], ";")))
        .when(name == CANCEL, F.when(phase == POST_ENCODE, NO_CANCEL).otherwise(DONE))
        .otherwise("")
    )
    return F.struct(
        tags.alias("tags"), path.alias("dst_path"), F.when(ranked, number).otherwise(job["priority"]).alias("priority"), F.when(canceled, "Canceled").otherwise(job["state"]).alias("state"),
        job["out_files"].alias("out_files"), F.array_append(job["replies"], F.struct(c["seq"].alias("seq"), reply.alias("reply"))).alias("replies"),
    )


def commanded(jobs: DataFrame, commands: DataFrame, key: str) -> DataFrame:
    """jobs: key, tags, dst_path, priority, state, out_files; commands: key, seq, phase, command, arg. The jobs after their commands, folded in the order of seq, with `replies` (seq, reply).

    A job's commands are those of its few scripts, so they are gathered in its row; other columns of jobs are left out.
    """
    steps = commands.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "phase", "command", "arg"))).alias("steps"))
    start = F.struct("tags", "dst_path", F.col("priority").cast("int").alias("priority"), "state", "out_files", F.array().cast("array<struct<seq:bigint,reply:string>>").alias("replies"))
    own = F.coalesce("steps", F.array().cast("array<struct<seq:bigint,phase:string,command:string,arg:string>>"))
    return jobs.join(steps, key, "left").select(key, F.aggregate(own, start, _taken).alias("_job")).select(key, "_job.*")
