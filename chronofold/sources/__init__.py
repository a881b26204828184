"""Record tables: schemas, readers, writers and session set-up."""
