"""Extensions: the reference semantics have no unbounded streams."""
