"""marlbrook: document-bundle search and corpus analytics on Spark DataFrames."""
