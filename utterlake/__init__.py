"""utterlake: speech-and-text corpus preparation as composable Spark DataFrame operators."""
