"""flowlens — network-flow analytics on Spark.

Captured packets become flow records with fifteen statistical features, flows are
labelled by overlap with attack intervals paired from an event log, and the labelled
table feeds monitoring queries (KPIs, flow table, timeline, event feed), stratified
splits, Spark ML models and their evaluation metrics.  Every step is a Spark
DataFrame / Spark ML / Structured Streaming job.
"""

__version__ = "0.1.0"
