"""Questions as a stream: answers as frames, messages to keep, and collections that were made anew."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import chat
from ..operators.ask import CHUNKS, Library, ask
from ..sources.tables import scope, stored

FRAMES = "question_id string, seq int, payload string, batch bigint"
MESSAGES = "question_id string, notebook_id string, seq int, role string, content string, sources_json string, batch bigint"


def frames(answers: DataFrame) -> DataFrame:
    """``(question_id, seq, payload)``: tokens and the closing frame of answers, one error frame of a question that failed."""
    good = chat.stream_frames(answers.where("error is null"))
    return good.unionByName(answers.where("error is not null").select("question_id", F.lit(0).alias("seq"), chat.error_frame(F.col("error")).alias("payload")))


def asking(
    questions: DataFrame, sources: DataFrame, entries: DataFrame, chunks: str, frames_to: str, messages_to: str, document: Callable[[Column], Column] | None = None,
    query: Callable[[Column], Column] | None = None, model: Callable[[Column], Column] | None = None,
) -> DataStreamWriter:
    """A writer that answers each batch of ``questions (question_id, notebook_id, question[, asked_at])``.

    Frames and messages of a batch have a partition of their own, overwritten if the batch is replayed; so have
    chunks made anew in the table ``chunks``, which holds stored chunks under any other ``batch``. A question
    that fails is one error frame and no message. With ``asked_at``, closing frames tell the milliseconds since.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        with scope(spark):
            # what a first attempt of this batch has made anew is not there for its replay
            held = read_chunks(spark, chunks).where(F.col("batch") != number).drop("batch")
            asked = ask(batch, Library(sources, entries, held), document, query, model)
            answers = asked.answers
            if "asked_at" in answers.columns:
                answers = answers.withColumn("latency_ms", (F.unix_millis(F.current_timestamp()) - F.unix_millis("asked_at")).cast("int"))
            answers = stored(answers, "answers")
            asked.rebuilt.write.mode("overwrite").parquet(f"{chunks}/batch={number}")
            frames(answers).write.mode("overwrite").parquet(f"{frames_to}/batch={number}")
            chat.as_messages(answers.where("error is null")).write.mode("overwrite").parquet(f"{messages_to}/batch={number}")

    return questions.writeStream.foreachBatch(write)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    spark.createDataFrame([], CHUNKS + ", batch bigint").write.mode("append").partitionBy("batch").parquet(path)
    return spark.read.schema(CHUNKS + ", batch bigint").parquet(path)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FRAMES).parquet(path)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MESSAGES).parquet(path)
