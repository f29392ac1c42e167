"""gleaner: build, audit and evaluate labelled text and source-code corpora on Spark."""
