"""Problem 4: private data in free text, found by a character-level bidirectional LSTM with CRF transitions, in numpy."""
