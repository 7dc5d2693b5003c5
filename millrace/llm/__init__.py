"""Operators of a training-data pipeline: joins, tokenising, models, rules, sharding, decontamination."""
