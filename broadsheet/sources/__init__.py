"""Readers and writers: pages, archive, labelled corpora, trained models."""
