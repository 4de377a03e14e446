"""Extensions: the daily job as a stream. Not part of the batch analysis."""
