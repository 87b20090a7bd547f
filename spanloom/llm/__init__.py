"""Training-data operators: whole-corpus text, token, media and mixing jobs on DataFrames."""
