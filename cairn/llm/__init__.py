"""Training-data operators: mixing, token counts, language ID, licences,
near and exact duplicates, decontamination, quality, LM scores, chat."""
