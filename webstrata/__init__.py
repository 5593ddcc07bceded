"""Spark-first analytics over crawled web data: pages, links, requests, events and vectors."""
