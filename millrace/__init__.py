"""Record pipelines on Spark: spool files, queue topics and SQL jobs as DataFrame functions."""
