"""The whole door: documents that come in with what an extractor found in them become facts, kinship links and an index
of uploads, batch by batch.

``documents`` have doc_id, patient_id, doc_date, author, title, text, content (what tells equal uploads) and found, an
array of the extractor's rows (as ``intake.assertions`` takes them, with an id). A document whose content was taken
before is left out. Facts go to a stored table by their id, edges between relatives that are new to one by both
patients, and the contents' hashes to the index, in this order: each merge is marked with the stream's name and the
batch's number, so a batch that comes again changes nothing, whether it was broken off between the tables or not, and
documents that come again in another stream are known by the index.

Defined results: of equal contents in one batch all are new, and the index has the last doc_id; rows without a document
that is new make no facts; an edge that is there is never changed; facts are active; an empty batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from carefold.operators import identity, intake
from carefold.operators.store import KeyedTable
from carefold.storage import materialize

FACTS = """id long, patient_id long, subject string, predicate string, value string, valid_from date, source string, raw_text string, source_document long, document_title string,
    resource_type string, analyte string, reading double, unit string, ref_range string, abnormal_flag string, drug string, substance string, reaction string, severity string, condition string,
    relation string, age_at_onset long, relative_name string, relative_dob string, relative_mrn string, factor string, factor_value string, status string"""  # fmt: skip
LINKS = "edge string, patient_id long, relative_id long, relation string, confidence string, consent boolean, proposed boolean, ord long"
INDEX = "hash string, doc_id long, patient_id long"


class Door:
    def __init__(self, spark: SparkSession, path: str, registry: DataFrame, today: Column, source: Column | None = None, buckets: int = 64):
        self.registry, self.today = registry, today
        self.source = F.lit("") if source is None else source
        self.facts, self.links, self.index = (
            KeyedTable.open(spark, f"{path}/{name}", schema, key, buckets) for name, schema, key in (("facts", FACTS, "id"), ("links", LINKS, "edge"), ("index", INDEX, "hash"))
        )

    def take(self, documents: DataFrame, batch: tuple[str, int]) -> None:
        """One batch of documents."""
        hashed = documents.withColumn("hash", F.sha2(F.coalesce("content", F.lit("")), 256))
        new = materialize(hashed.join(self.index.read().select("hash"), "hash", "left_anti"), "door-documents")
        said = new.filter("doc_id IS NOT NULL").select("doc_id", *intake.OF_DOCUMENT, F.explode("found").alias("f")).select("doc_id", *intake.OF_DOCUMENT, "f.*")
        made = intake.facts_with(intake.assertions(said, F.lit(""), self.source), self.today).withColumn("status", F.lit("active"))
        made = materialize(made, "door-facts")
        self.facts.merge(made, batch=batch)
        kin = identity.relatives(made.withColumn("relative_dob", F.to_date(F.try_to_timestamp("relative_dob"))))
        edges = identity.links(identity.match_relatives(kin, self.registry))
        named = edges.withColumn("edge", F.concat_ws(" ", "patient_id", "relative_id"))
        self.links.merge(named.join(self.links.read().select("edge"), "edge", "left_anti"), batch=batch)
        self.index.merge(new, order=F.col("doc_id"), batch=batch)

    def run(self, stream: DataFrame, checkpoint: str, name: str = "door") -> StreamingQuery:
        """Take what the stream has by now; ``checkpoint`` is where it goes on from, a folder that all share."""
        writer = stream.writeStream.foreachBatch(lambda batch, n: self.take(batch, (name, n)))
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
