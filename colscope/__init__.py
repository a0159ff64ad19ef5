"""colscope: table profiling, catalogue search and guarded SQL as Spark jobs.

Every public function takes and returns DataFrames; Spark plans and scales
the work. Model calls (annotation text, dense embeddings) stay outside and
plug in as caller-supplied columns or pandas UDFs.
"""

__version__ = "0.1.0"
