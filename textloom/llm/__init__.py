"""Operations for training-data corpora; nothing else in textloom imports this subpackage."""
