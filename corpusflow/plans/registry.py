"""The modules whose QUERIES and ORACLE make up the driver's contract, without those of the optional subpackage."""

from corpusflow.plans import documents, edits, measures, reviews, snapshots, texts

MODULES = [snapshots, texts, reviews, edits, documents, measures]
